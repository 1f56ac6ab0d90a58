"""Rolling summary plus tail: a token trigger, eviction of a prefix that ends with an assistant message.

The running state is inherently sequential, so it is a small keyed fold: one Python object per stream, the same one in
batch (applyInPandas) and streaming. The first cut alone has a closed form in windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import rendered
from palimpsest.operators.stream import CONVERSATIONS, Stream, prefix_tokens
from palimpsest.session import ship

#: (summary so far, evicted text) -> new summary.
Summarizer = Callable[[str, str], str]


def keep_summary(words: int = 20) -> Summarizer:
    """A summarizer without a model: the last ``words`` tokens of what was known and what goes."""
    return lambda summary, evicted: " ".join(f"{summary} {evicted}".split()[-words:])


@dataclass
class Budgets:
    trigger: int = 200
    prefix: int = 80


@dataclass
class Rolling:
    """One stream's state. Token counts add up over messages; a compression counts what it keeps anew."""

    budgets: Budgets
    summarize: Summarizer
    summary: str = ""
    tail: list[tuple] = field(default_factory=list)  # ordinal, role, rendered text, session, header
    tail_tokens: int = 0
    issue: str | None = None

    @staticmethod
    def tokens(text: str) -> int:
        return len(text.split())

    @property
    def history(self) -> int:
        return self.tokens(self.summary) + self.tail_tokens

    @staticmethod
    def _opens(before: tuple | None, message: tuple) -> bool:
        """Whether a message's header stands before it: in the first message shown and wherever the session changes."""
        return bool(message[4]) and (before is None or before[3] != message[3])

    @classmethod
    def weigh(cls, before: tuple | None, message: tuple) -> int:
        """Tokens that a message adds behind another one, its session's header included."""
        return cls.tokens(message[2]) + (cls.tokens(message[4]) if cls._opens(before, message) else 0)

    def _sizes(self, messages: list[tuple]) -> list[int]:
        return [self.weigh(b, m) for b, m in zip([None, *messages], messages, strict=False)]

    def cut(self) -> int:
        """Length of the prefix to evict: the shortest that ends with an assistant message and reaches the budget, else
        the longest such that leaves something, else 0."""
        if len(self.tail) <= 1:
            return 0
        total, last = 0, 0
        for n, (message, size) in enumerate(zip(self.tail, self._sizes(self.tail), strict=True), 1):
            total += size
            if message[1] == "assistant":
                if total >= self.budgets.prefix:
                    return n
                if n < len(self.tail):
                    last = n
        return last

    def ingest(self, ordinal: int, role: str, text: str, session=None, header: str | None = None) -> dict | None:
        """Takes a message; gives the record of a compression if one happened. Between compressions the count only grows
        by the new message."""
        message = (ordinal, role, text, session, header)
        self.tail_tokens += self.weigh(self.tail[-1] if self.tail else None, message)
        self.tail.append(message)
        if role != "assistant" or self.history <= self.budgets.trigger:
            return None
        return self.compress(ordinal)

    def compress(self, ordinal: int) -> dict | None:
        """Cuts the tail and gives the record of it; None if no cut is legal."""
        n = self.cut()
        if n == 0:
            self.issue = "no_legal_assistant_cut"
            return None
        gone, self.tail = self.tail[:n], self.tail[n:]
        self.tail_tokens = sum(self._sizes(self.tail))
        shown = [f"{m[4]}\n{m[2]}" if self._opens(b, m) else m[2] for b, m in zip([None, *gone], gone, strict=False)]
        evicted = "\n".join(shown)
        self.summary, self.issue = self.summarize(self.summary, evicted).strip(), None
        return {
            "at": ordinal, "cut": n, "first_evicted": gone[0][0], "last_evicted": gone[-1][0], "evicted_tokens": self.tokens(evicted),
            "summary_tokens": self.tokens(self.summary), "tail_tokens": self.tail_tokens,
        }

    def finish(self) -> dict:
        if self.tail and self.tail[-1][1] == "user":
            self.issue = self.issue or "terminal_unpaired_user"
        return {
            "summary": self.summary, "summary_tokens": self.tokens(self.summary), "tail_first": self.tail[0][0] if self.tail else None,
            "tail_messages": len(self.tail), "history_tokens": self.history, "issue": self.issue,
        }


COMPRESSIONS = "at long, cut long, first_evicted long, last_evicted long, evicted_tokens long, summary_tokens long, tail_tokens long"
FINAL = "summary string, summary_tokens long, tail_first long, tail_messages long, history_tokens long, issue string"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _typed(rows: list[dict], schema: str, key: str, value) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_names(schema))
    for part in schema.split(", "):
        name, kind = part.split()
        out[name] = out[name].astype("Int64" if kind == "long" else object)
    out.insert(0, key, value)
    return out


def _messages(stream: DataFrame, s: Stream) -> DataFrame:
    ship(stream.sparkSession)
    session = F.col(s.session).cast("string") if s.session else F.lit(None).cast("string")
    return stream.select(
        F.col(s.key).alias("key"), F.col(s.order).alias("ordinal"), F.col(s.role).alias("role"), rendered(s.role, F.coalesce(s.text, F.lit(""))).alias("line"),
        session.alias("session"), s.header().alias("header"),
    )


def ingest_all(state: Rolling, rows: pd.DataFrame) -> list[dict]:
    """The compressions that a stream's messages, in order, bring about."""
    done = [state.ingest(int(m.ordinal), m.role, m.line, m.session, m.header) for m in rows.sort_values("ordinal").itertuples()]
    return [d for d in done if d]


def compressions(stream: DataFrame, budgets: Budgets, summarize: Summarizer | None = None, s: Stream = CONVERSATIONS) -> DataFrame:
    """(key, at, cut, first_evicted, ...): one row per compression of each stream."""
    summarize = summarize or keep_summary()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return _typed(ingest_all(Rolling(budgets, summarize), rows), COMPRESSIONS, s.key, rows["key"].iloc[0])

    return _messages(stream, s).groupBy("key").applyInPandas(fold, f"{s.key} {s.kind(stream)}, {COMPRESSIONS}")


def final_states(stream: DataFrame, budgets: Budgets, summarize: Summarizer | None = None, s: Stream = CONVERSATIONS) -> DataFrame:
    """(key, summary, summary_tokens, tail_first, ...): each stream's state at its end."""
    summarize = summarize or keep_summary()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state = Rolling(budgets, summarize)
        ingest_all(state, rows)
        return _typed([state.finish()], FINAL, s.key, rows["key"].iloc[0])

    return _messages(stream, s).groupBy("key").applyInPandas(fold, f"{s.key} {s.kind(stream)}, {FINAL}")


def first_cut(stream: DataFrame, budgets: Budgets, s: Stream = CONVERSATIONS) -> DataFrame:
    """(key, at, cut): each stream's first compression, in windows: the first assistant message over the trigger, and of
    the messages up to it the first legal cut that reaches the prefix budget, else the last one before it. Headers of
    sessions count, as in the fold."""
    n = F.row_number().over(s.window)
    rows = prefix_tokens(stream, s).select(s.key, F.col(s.order).alias("at"), s.role, n.alias("n"), F.col("prefix_tokens").alias("cum"))
    answer = F.col(s.role) == "assistant"
    trigger = rows.filter(answer & (F.col("cum") > budgets.trigger)).groupBy(s.key).agg(F.min("n").alias("last"), F.min("at").alias("at"))
    upto = rows.drop("at").join(trigger, s.key).filter(F.col("n") <= F.col("last"))
    found = upto.groupBy(s.key, "at").agg(
        F.min(F.when(answer & (F.col("cum") >= budgets.prefix), F.col("n"))).alias("reached"),
        F.max(F.when(answer & (F.col("n") < F.col("last")), F.col("n"))).alias("earlier"),
        F.max("last").alias("last"),
    )
    cut = F.coalesce("reached", "earlier")
    return found.filter(F.col("last") > 1).select(s.key, F.col("at").cast("long").alias("at"), cut.cast("long").alias("cut")).filter("cut is not null")


def true_tails(stream: DataFrame, compressed: DataFrame, compat: bool = False, s: Stream = CONVERSATIONS) -> DataFrame:
    """The messages behind each stream's last eviction. ``compat``: those with an order above the last cut's length, a
    rule that takes the length for an order and loses messages after the first compression."""
    value = "cut" if compat else "last_evicted"
    last = compressed.groupBy(s.key).agg(F.max_by(value, "at").alias("_from"))
    return stream.join(last, s.key, "left").filter(F.col("_from").isNull() | (F.col(s.order) > F.col("_from"))).drop("_from")


def replay_identical(first: DataFrame, second: DataFrame) -> bool:
    """Whether two runs gave the same rows, repeats included."""
    return first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()


def tail_window(stream: DataFrame, s: Stream = CONVERSATIONS, n: int = 2) -> DataFrame:
    """The last n messages of each stream."""
    back = Window.partitionBy(s.key).orderBy(F.desc(s.order))
    return stream.withColumn("_k", F.row_number().over(back)).filter(F.col("_k") <= n).drop("_k")


