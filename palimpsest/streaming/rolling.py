"""The rolling summary as a stateful stream: the fold of the batch, its state kept by Spark between batches.

What the trigger needs is a value of fixed size; the tail is a list to which messages are appended. The list is read only
when a prefix goes, so a batch without a compression writes its own messages and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.rolling import COMPRESSIONS, Budgets, Rolling, Summarizer, _messages, _typed, keep_summary
from palimpsest.operators.stream import CONVERSATIONS, Stream

#: ``answers`` counts the tail's assistant messages; the last session tells whether the next message has a header.
NOW = "summary string, summary_tokens long, tail_tokens long, messages long, answers long, last_session string, last_at long, issue string"
TAIL = "ordinal long, role string, line string, session string, header string"


class _Now:
    """The value state while a batch of one stream is taken in."""

    def __init__(self, row: tuple | None):
        row = row or ("", 0, 0, 0, 0, None, None, None)
        self.summary, self.summary_tokens, self.tail_tokens, self.messages, self.answers, self.last_session, self.last_at, self.issue = row

    def row(self) -> tuple:
        return self.summary, self.summary_tokens, self.tail_tokens, self.messages, self.answers, self.last_session, self.last_at, self.issue


class RollingProcessor(StatefulProcessor):
    """One stream per key. ``Rolling`` decides what is cut, as in batch."""

    def __init__(self, budgets: Budgets, summarize: Summarizer, key: str):
        self.budgets, self.summarize, self.key = budgets, summarize, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now, self.tail = handle.getValueState("now", NOW), handle.getListState("tail", TAIL)

    def _has_cut(self, now: _Now) -> bool:
        """Whether a tail that ends with an assistant message has a legal cut, known without reading it."""
        return now.messages > 1 and (now.tail_tokens >= self.budgets.prefix or now.answers > 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = _Now(tuple(self.now.get()) if self.now.exists() else None)
        stored = now.messages > 0  # whether the list holds messages that ``fresh`` does not
        rewritten, fresh, done = False, [], []
        for m in pd.concat(list(rows)).sort_values("ordinal").itertuples():
            message = (int(m.ordinal), m.role, m.line, m.session, m.header)
            if now.last_at is not None and message[0] <= now.last_at:
                raise ValueError(f"message {message[0]} of stream {key[0]} comes after message {now.last_at}")
            before = (None, None, None, now.last_session) if now.messages else None
            now.tail_tokens += Rolling.weigh(before, message)
            fresh.append(message)
            now.messages, now.answers = now.messages + 1, now.answers + (m.role == "assistant")
            now.last_session, now.last_at = m.session, message[0]
            if m.role != "assistant" or now.summary_tokens + now.tail_tokens <= self.budgets.trigger:
                continue
            if not self._has_cut(now):
                now.issue = "no_legal_assistant_cut"
                continue
            whole = [*(tuple(x) for x in self.tail.get()), *fresh] if stored else fresh
            fold = Rolling(self.budgets, self.summarize, now.summary, whole, now.tail_tokens, now.issue)
            done.append(fold.compress(message[0]))
            fresh, stored, rewritten = fold.tail, False, True
            now.summary, now.tail_tokens, now.issue = fold.summary, fold.tail_tokens, None
            now.summary_tokens, now.messages = Rolling.tokens(fold.summary), len(fold.tail)
            now.answers = sum(x[1] == "assistant" for x in fold.tail)
        if rewritten and not fresh:
            self.tail.clear()
        elif rewritten:
            self.tail.put(fresh)
        else:
            self.tail.appendList(fresh)
        self.now.update(now.row())
        yield _typed(done, COMPRESSIONS, self.key, key[0])

    def close(self) -> None:
        pass


def stream_compressions(stream: DataFrame, budgets: Budgets, summarize: Summarizer | None = None, s: Stream = CONVERSATIONS) -> DataFrame:
    """(key, at, cut, ...) as compressions happen. Messages of a key must come in order over the batches, and one that
    comes late is an error; within one batch they are sorted. Sessions that ``session()`` makes keep state in RocksDB, which
    list state needs."""
    processor = RollingProcessor(budgets, summarize or keep_summary(), s.key)
    return _messages(stream, s).groupBy("key").transformWithStateInPandas(processor, f"{s.key} {s.kind(stream)}, {COMPRESSIONS}", "append", "none")


def _state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def running_states(spark: SparkSession, checkpoint: str, key: str = CONVERSATIONS.key) -> DataFrame:
    """(key, summary, summary_tokens, tail_messages, history_tokens, issue) of each stream as of the last batch that a
    query's checkpoint holds, read as a table while no batch runs."""
    now = _state(spark, checkpoint, "now").select("key.*", "value.*")
    return now.select(
        F.col(now.columns[0]).alias(key), "summary", "summary_tokens", F.col("messages").alias("tail_messages"),
        (F.col("summary_tokens") + F.col("tail_tokens")).alias("history_tokens"), "issue",
    )


def running_tails(spark: SparkSession, checkpoint: str, key: str = CONVERSATIONS.key) -> DataFrame:
    """(key, ordinal, role, line, session, header): the messages in each stream's tail as of the checkpoint's last batch."""
    tail = _state(spark, checkpoint, "tail").select("key.*", "list_element.*")
    return tail.withColumnRenamed(tail.columns[0], key)
