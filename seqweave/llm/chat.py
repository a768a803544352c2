"""Chat formatting: conversation logs folded into final messages, rendered with a reversible template and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import blocks, shared_dir, small_batches, tidy

#: The template: OPEN role MIDDLE text CLOSE. Inside roles and texts a backslash stands before each backslash, #, < and :
#: (the last in roles only), so that none of the marks can occur there.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_FRAGMENT = re.compile(r"(?s)### ([^\\:#<]*(?:\\.[^\\:#<]*)*): ([^\\#<]*(?:\\.[^\\#<]*)*)</turn>\n")
_ESCAPED = re.compile(r"(?s)\\(.)")


def fold(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, start, message, role, text) of an event log (conv_id, seq, event, message, role, text).

    The first event of a message is its start and names its role. `delta` appends its text (so a whole message is one
    delta); `edit` replaces the text so far; `regenerate` empties it and what follows builds it anew. An edit or a
    regeneration also drops the messages that began after that message and before that event: the conversation goes on
    from there. Events of a message go by (seq, event, text), nulls first; null texts are empty, null and unknown events
    deltas, a null role is empty. Events without a message id belong to one message of the conversation, those without
    a conversation to one conversation. The events of a message are sorted (with spilling), and only those from its last
    edit or regeneration on are gathered: what one task holds is a final text. Where later turns are dropped, only ids and
    numbers of a conversation are sorted.
    """
    rows = events.select("conv_id", "message", "seq", F.coalesce("event", F.lit("delta")).alias("event"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    own = Window.partitionBy("conv_id", "message")
    rows = rows.withColumn("number", F.row_number().over(own.orderBy("seq", "event", "text", "role")))
    reset = F.col("event").isin("edit", "regenerate")
    rows = rows.withColumn("last", F.coalesce(F.max(F.when(reset, F.col("number"))).over(own), F.lit(0)))
    rest = F.when(F.col("number") >= F.col("last"), F.struct("number", F.when(F.col("event") == "regenerate", "").otherwise(F.col("text")).alias("text")))
    messages = rows.groupBy("conv_id", "message").agg(
        F.min(F.when(F.col("number") == 1, F.struct("seq", "role"))).alias("first"),
        F.min(F.when(F.col("number") == F.col("last"), F.struct("seq"))).alias("reset"),
        F.array_sort(F.collect_list(rest)).alias("rest"),
    )
    text = F.array_join(F.transform("rest", lambda e: e["text"]), "")
    messages = messages.select("conv_id", F.col("first.seq").alias("start"), "message", F.col("first.role").alias("role"), text.alias("text"), F.col("reset.seq").alias("fork"))
    before = Window.partitionBy("conv_id").orderBy("start", "message").rowsBetween(Window.unboundedPreceding, -1)
    forked = events.where(F.col("event").isin("edit", "regenerate")).select(F.col("conv_id").alias("forked")).distinct()
    gone = messages.drop("text", "role").join(forked, F.col("conv_id").eqNullSafe(F.col("forked")), "left_semi").withColumn("cut", F.max("fork").over(before)).where("cut > start").select("conv_id", "message")
    kept = messages.join(gone, messages.conv_id.eqNullSafe(gone.conv_id) & messages.message.eqNullSafe(gone.message), "left_anti")
    return kept.select("conv_id", "start", "message", "role", "text")


def _escape(c: Column, marks: str) -> Column:
    return F.regexp_replace(c, rf"([\\#<{marks}])", r"\\$1")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, start, message, formatted, loss_start, loss_end): a fragment for each message, to be joined by (start, message).

    The loss mask covers the escaped text of messages whose role is assistant, in characters of the fragment; others have nulls.
    """
    head, text = F.concat(F.lit(OPEN), _escape(F.col("role"), ":"), F.lit(MIDDLE)), _escape(F.col("text"), "")
    mine = F.col("role") == "assistant"
    return messages.select(
        "conv_id", "start", "message", F.concat(head, text, F.lit(CLOSE)).alias("formatted"),
        F.when(mine, F.length(head)).cast("long").alias("loss_start"), F.when(mine, F.length(head) + F.length(text)).cast("long").alias("loss_end"),
    )


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(fragment: str) -> tuple[str, str]:
    """The role and the text of a fragment."""
    m = _FRAGMENT.fullmatch(fragment)
    if not m:
        raise ValueError(f"no turn: {fragment[:60]!r}")
    return unescape(m[1]), unescape(m[2])


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@tidy
def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    rows: list[tuple] = []
    state = None

    def done() -> tuple:
        return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

    for batch in batches:
        for block in blocks(batch, "formatted"):
            for r in block.to_pylist():
                if state is None or state[0] != r["conv_id"]:
                    if state:
                        rows.append(done())
                    state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(r["formatted"])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[5] += len(r["formatted"])
                if r["loss_start"] is not None:
                    own = unescape(r["formatted"][r["loss_start"] : r["loss_end"]])
                    state[3] += len(own)
                    state[4].update(own.encode())
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names]))
                rows = []
    if state:
        rows = [done()]
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names]))


def digest(rendered: DataFrame) -> DataFrame:
    """One row for each conversation of render(): its turns, the text under the loss mask and the formatted length.

    A digest runs over a conversation in order, so the conversation's fragments stream through one task, sorted by
    Spark with spilling; the task holds one fragment and the state of two hashes.
    """
    small_batches(rendered.sparkSession)
    return rendered.repartition("conv_id").sortWithinPartitions("conv_id", "start", "message").mapInArrow(_digested, _DIGEST)


#: Characters of a streamed fragment.
FRAGMENT = 200


def streamed(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the event log that a chat server would have written of them; folded, it gives the rows again.

    seq is (turn, number among equal turns, place). Each text comes in fragments. Some messages (by a hash) had a first answer that was regenerated, others were typed
    wrongly and edited: the log has these events, too. Rows of a conversation go by turn, then role and text, nulls first;
    rows that repeat are messages of their own.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    again = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.withColumn("again", again).withColumn("message", F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lpad(F.col("again").cast("string"), 12, "0")))
    text = F.coalesce("text", F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{FRAGMENT}}}"), F.lit(0))
    event = lambda kind, t: F.struct(F.lit(kind).alias("event"), t.alias("text"))
    deltas = lambda texts: F.transform(texts, lambda x: event("delta", x))
    kind = F.pmod(F.xxhash64("conv_id", "message"), F.lit(8))
    log = (
        F.when(kind == 0, F.concat(F.array(event("delta", F.lit("a first answer ")), event("delta", F.left(text, F.lit(20))), event("regenerate", F.lit(None).cast("string"))), deltas(pieces)))
        .when(kind == 1, F.concat(F.array(event("delta", F.lit("typed wrongly"))), F.array(event("edit", F.coalesce(F.get(pieces, F.lit(0)), F.lit("")))), deltas(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))))))
        .otherwise(F.concat(F.array(event("delta", F.lit(""))), deltas(pieces)))
    )
    return rows.select("conv_id", "turn", "again", "message", "role", F.posexplode(log).alias("place", "x")).select(
        "conv_id", F.struct("turn", "again", "place").alias("seq"), F.col("x.event").alias("event"), "message", F.when(F.col("place") == 0, F.col("role")).alias("role"), F.col("x.text").alias("text")
    )


def formatted_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as an event log, folded, rendered, written to a new shared folder and read back as digests.

    Rows of a conversation go by turn, then role and text, nulls first; rows that repeat are turns of their own. Null
    texts and roles are empty; rows with a null conv_id are one conversation. Other columns are not read.
    """
    path = shared_dir(spark, "chat")
    made = render(fold(streamed(conversations)))
    made.write.parquet(path)
    return digest(spark.read.schema(made.schema).parquet(path))
