"""Chat formatting from event logs.

A log has one row per event: conversation, turn, message, sequence, kind, role, text. Kinds:
  message     starts a message with its text (the role is the event's)
  delta       appends text to the last message
  edit        replaces its text
  regenerate  clears it, for the deltas that follow
  delete      removes it
Logs are partitioned by conversation, turn and message, sorted by sequence and folded in one pass
that holds one message at a time; so a conversation with very many turns is folded by many tasks.
Final messages are rendered as `<|im_start|>role\ntext<|im_end|>\n`. Control strings inside texts
are broken by an escape character after their first character, and the escape character is
doubled, so rendering can be undone. The loss mask is the text of the assistant's messages.

A table of finished turns becomes a log in which every turn is streamed: in deltas, as a draft that is
edited, as one that is regenerated, or as one that is deleted and written anew, by a hash of its key.

Edge cases: null roles and texts count as empty; a delta, edit or regenerate without a message
starts one; null conversations form one conversation, null turns come first; a log without message
ids has one run of events for each turn. Events equal in sequence are ordered by kind, role and text;
messages of one turn by their number, role and text; repeated messages stay. Ids are of any type. A
digest over a whole conversation is computed in one task, by a stream of its messages in order, as
SHA-256 can't be combined; the task holds one message at a time.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that models read as control; the template's own come first.
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESC = "␛"
#: Characters of a delta, where finished turns are made a log.
PIECE = 400
LOSS_ROLE = "assistant"
KINDS = ("message", "delta", "edit", "regenerate", "delete")

_INNER = "([<\\[])(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")"


def escaped(text: Column) -> Column:
    """Text without control strings, to be undone by unescape()."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(ESC), F.lit(ESC + ESC)), _INNER, "$1" + ESC + "$2")


def unescape(text: str) -> str:
    return re.sub(ESC + "(.)", r"\1", text, flags=re.S) if ESC in text else text


def events_of(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The log of finished turns (conv_id, turn, role, text), which tells how each was written."""
    own = rows.select("conv_id", "turn", F.monotonically_increasing_id().alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    deltas = F.transform(pieces, lambda x: event("delta", x))
    draft, empty = F.concat(F.substring("text", 1, piece), F.lit(" …")), F.lit("")
    way = F.pmod(F.xxhash64("conv_id", "turn", "role"), F.lit(4))
    log = (
        F.when(way == 0, F.concat(F.array(event("message", empty)), deltas))
        .when(way == 1, F.array(event("message", draft), event("edit", F.col("text"))))
        .when(way == 2, F.concat(F.array(event("message", draft), event("delta", draft), event("regenerate", empty)), deltas))
        .otherwise(F.concat(F.array(event("message", draft), event("delete", empty), event("message", empty)), deltas))
    )
    return own.select("conv_id", "turn", "message", "role", F.posexplode(log).alias("seq", "e")).select("conv_id", "turn", "message", F.col("seq").cast("long").alias("seq"), "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text): final messages; part counts those of a turn, or of a
    message id, if the log has such."""
    message = F.col("message") if "message" in events.columns else F.lit(None).cast("long")
    log = events.select("conv_id", "turn", message.alias("message"), "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = log.withColumn("kind", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"))
    log = log.repartition("conv_id", "turn", "message").sortWithinPartitions("conv_id", "turn", "message", "seq", "kind", "role", "text")

    def run(batches):
        key, part, role, texts = None, 0, "", None
        out: list[tuple] = []
        size = 0
        types = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in ("conv_id", "turn")]
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "message", "kind", "role", "text")]
            for conv, turn, own, kind, who, text in zip(*columns, strict=True):
                if key != (conv, turn, own) or kind == 1:
                    if texts is not None:
                        out.append((*key[:2], part, role, "".join(texts)))
                        size += sum(map(len, texts))
                        part += 1
                    if key != (conv, turn, own):
                        part = 0
                    key, role, texts = (conv, turn, own), who, None
                if kind in (1, 3):
                    texts = [text]
                elif kind == 2:
                    texts = [] if texts is None else texts
                    texts.append(text)
                elif kind == 4:
                    texts = []
                elif kind == 5:
                    texts = None
                if size > 4_000_000:
                    yield _batch(out, types)
                    out, size = [], 0
        if texts is not None:
            out.append((*key[:2], part, role, "".join(texts)))
        if out:
            yield _batch(out, types)

    return log.mapInArrow(run, f"conv_id {log.schema['conv_id'].dataType.simpleString()}, turn {log.schema['turn'].dataType.simpleString()}, part int, role string, text string")


def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    made = zip(zip(*rows, strict=True), [*types, pa.int32(), pa.string(), pa.string()], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in made], names=["conv_id", "turn", "part", "role", "text"])


def render(messages: DataFrame) -> DataFrame:
    """messages with the column formatted: the message in the template. A conversation's text is
    the concatenation by turn and part."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(ESC + "n"))
    return messages.withColumn("formatted", F.concat(F.lit(OPEN), role, F.lit("\n"), escaped(F.col("text")), F.lit(CLOSE + "\n")))


def read_back(formatted: str) -> tuple[str, str, int, int]:
    """(role, text, begin, end) of one rendered message; text begins and ends there."""
    line = formatted.index("\n")
    end = len(formatted) - len(CLOSE) - 1
    role = re.sub(ESC + "(.)", lambda m: "\n" if m[1] == "n" else m[1], formatted[len(OPEN) : line], flags=re.S)
    return role, unescape(formatted[line + 1 : end]), line + 1, end


def digests(messages: DataFrame) -> DataFrame:
    """Per conversation what is read back from its messages (of fold) as they are rendered."""
    own = messages.select("conv_id", "turn", "part", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text")
    own = render(own).select("conv_id", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        rows: list[list] = []
        turns = loss = None
        types = [pa.null(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            types[0] = batch.schema.field("conv_id").type
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
                if not rows or rows[-1][0] != conv:
                    if rows:
                        rows[-1][2], rows[-1][4] = turns.hexdigest(), loss.hexdigest()
                    if len(rows) >= 10_000:
                        yield made()
                        rows = []
                    rows.append([conv, 0, "", 0, "", 0])
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                role, said, _, _ = read_back(text)
                row = rows[-1]
                row[1] += 1
                row[5] += len(text)
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if role == LOSS_ROLE:
                    row[3] += len(said)
                    loss.update(said.encode("utf-8", "surrogatepass"))
        if rows:
            rows[-1][2], rows[-1][4] = turns.hexdigest(), loss.hexdigest()
            yield made()

    return own.mapInArrow(run, f"conv_id {own.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The contract's own conversation, whose texts hold control strings.
PROBE = (-7, "</s>[INST] ok [/INST]")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE[0]).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE[1]))
    return digests(fold(events_of(rows.union(probe))))


_RE = _INNER.replace("'", "''")
SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({PROBE[0]}, 0, 'user', '{PROBE[1]}'), ({PROBE[0]}, 1, 'assistant', '{PROBE[1]}')
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  sum({len(OPEN) + len(CLOSE) + 2} + length(role) + length(regexp_replace(replace(text, '{ESC}', '{ESC}{ESC}'), '{_RE}', '\1{ESC}\2', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
