"""Message streams: ordering, headers, turn units, legal cuts, tails. All closed forms over one partitioning.

A stream is a DataFrame with the columns that ``Stream`` names. Rows of a stream are ordered by ``order``; every window
here is partitioned by ``key``, so one exchange serves all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import rendered, session_header, token_count
from palimpsest.functions.time import session_timestamp


@dataclass(frozen=True)
class Stream:
    key: str = "conv_id"
    order: str = "turn"
    role: str = "role"
    text: str = "text"
    session: str | None = None
    date: str | None = None

    @property
    def window(self):
        return Window.partitionBy(self.key).orderBy(self.order)

    def header(self) -> Column:
        """The line that opens a message's session; null for streams without dated sessions."""
        return session_header(self.session, self.date) if self.session and self.date else F.lit(None).cast("string")

    def kind(self, stream: DataFrame) -> str:
        """The type of the key, whatever the source gives."""
        return stream.schema[self.key].dataType.simpleString()

    def same_session(self) -> Column:
        if self.session is None:
            return F.lit(True)
        return F.lag(self.session).over(self.window).eqNullSafe(F.col(self.session))

    def opened(self) -> Column:
        """The header that stands before a message: of the stream's first one and wherever the session changes; else null."""
        if not (self.session and self.date):
            return F.lit(None).cast("string")
        first = F.row_number().over(self.window) == 1
        return F.when(first | ~self.same_session(), self.header())

    def message_tokens(self) -> Column:
        """Tokens of the rendered message, without a header."""
        return token_count(rendered(self.role, F.coalesce(F.col(self.text), F.lit(""))))


CONVERSATIONS = Stream()
#: What ``messages_of_samples`` gives.
SAMPLES = Stream("question_id", "unit_ordinal", "role", "content", "session_index", "session_date")


def messages_of_samples(samples: DataFrame) -> DataFrame:
    """Question rows with nested sessions to message rows (question_id, unit_ordinal, session_index, session_id,
    session_date, role, content): sessions by parsed date, source order at ties. Gold fields are never selected."""
    zipped = F.arrays_zip(
        F.col("haystack_dates").alias("date"), F.col("haystack_session_ids").alias("id"), F.col("haystack_sessions").alias("messages")
    )
    sessions = samples.select("question_id", F.posexplode(zipped).alias("original_index", "s"))
    by_time = Window.partitionBy("question_id").orderBy(session_timestamp("s.date"), "original_index")
    ranked = sessions.withColumn("session_index", F.row_number().over(by_time) - 1)
    rows = ranked.select(
        "question_id", "session_index", F.col("s.id").alias("session_id"), F.col("s.date").alias("session_date"), F.posexplode("s.messages").alias("message_index", "m")
    )
    ordinal = F.row_number().over(Window.partitionBy("question_id").orderBy("session_index", "message_index")) - 1
    return rows.select(
        "question_id", ordinal.alias("unit_ordinal"), "session_index", "session_id", "session_date",
        F.col("m.role").alias("role"), F.coalesce(F.col("m.content"), F.lit("")).alias("content"),
    )


def with_headers(messages: DataFrame) -> DataFrame:
    """Adds ``opens_session`` and ``raw_text``: the rendered message, after its session's header where one opens."""
    w = Window.partitionBy("question_id").orderBy("unit_ordinal")
    opens = ~F.lag("session_index").over(w).eqNullSafe(F.col("session_index"))
    line = rendered("role", "content")
    head = F.concat(session_header("session_index", "session_date"), F.lit("\n"), line)
    return messages.withColumn("opens_session", opens).withColumn("raw_text", F.when(F.col("opens_session"), head).otherwise(line))


def transcripts(stream: DataFrame, s: Stream = CONVERSATIONS) -> DataFrame:
    """(key, transcript): each stream's rendered messages on lines of their own."""
    lines = stream.groupBy(s.key).agg(F.array_sort(F.collect_list(F.struct(s.order, rendered(s.role, s.text).alias("line")))).alias("x"))
    return lines.select(s.key, F.array_join(F.transform("x", lambda m: m["line"]), "\n").alias("transcript"))


def turn_units(stream: DataFrame, s: Stream = CONVERSATIONS) -> DataFrame:
    """Adds ``unit``: a user message and the assistant's answer right behind it, in one session, share a number from 0.

    Greedy pairing has a closed form, as an assistant message can pair only with the user message before it."""
    joins = (F.col(s.role) == "assistant") & (F.lag(s.role).over(s.window) == "user") & s.same_session()
    return stream.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn(
        "unit", (F.sum("_new").over(s.window) - 1).cast("long")
    ).drop("_new")


def legal_cuts(stream: DataFrame, s: Stream = CONVERSATIONS) -> DataFrame:
    """(key, cut): prefix lengths at which a stream may be cut: 0 and behind every assistant message."""
    n = stream.select(s.key, s.role, F.row_number().over(s.window).cast("long").alias("cut"))
    return n.filter(F.col(s.role) == "assistant").select(s.key, "cut").union(stream.select(s.key, F.lit(0).cast("long")).distinct())


def prefix_tokens(stream: DataFrame, s: Stream = CONVERSATIONS) -> DataFrame:
    """Adds ``tokens`` of each rendered message, with the header that opens its session, and their running sum
    ``prefix_tokens``."""
    tokens = s.message_tokens() + token_count(s.opened())
    return stream.withColumn("tokens", tokens).withColumn("prefix_tokens", F.sum("tokens").over(s.window))


def tail_by_turns(stream: DataFrame, budget: int, s: Stream = CONVERSATIONS) -> DataFrame:
    """The messages of the last whole turn units that fit the budget; the newest units come first, none is cut."""
    units = turn_units(stream.withColumn("tokens", s.message_tokens()), s)
    # the sum from the end up to and with all of this message's unit
    from_end = Window.partitionBy(s.key).orderBy(F.desc("unit")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return units.withColumn("_behind", F.sum("tokens").over(from_end)).filter(F.col("_behind") <= budget).drop("_behind")


def tail_by_tokens(stream: DataFrame, budget: int, s: Stream = CONVERSATIONS) -> DataFrame:
    """(key, tail, full_tokens, trimmed): the last ``budget`` white-space tokens of each transcript."""
    words = F.filter(F.split("transcript", r"\s+"), lambda w: w != "")
    out = transcripts(stream, s).select(s.key, words.alias("w"), "transcript")
    full = F.size("w").cast("long")
    last = F.array_join(F.slice("w", F.greatest(F.lit(1), F.size("w") - budget + 1), F.lit(budget)), " ")
    fits = full <= budget
    return out.select(s.key, F.when(fits, F.col("transcript")).otherwise(last).alias("tail"), full.alias("full_tokens"), (~fits).alias("trimmed"))


def sessionize(stream: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Adds ``session_index`` to time-stamped rows: a new session after a gap; for sources without sessions."""
    w = Window.partitionBy(key).orderBy(at)
    gap = F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(w))
    return stream.withColumn("session_index", F.sum(F.when(gap > gap_seconds, 1).otherwise(0)).over(w).cast("long"))
