"""Chat formatting from an event log.

Events of a conversation are sorted by sequence and folded into messages: `message` opens or replaces
the text of a turn, `delta` appends to it, `edit` replaces it, and `regenerate` empties it, so that the
deltas after it make the new text. The folded turns are rendered one by one, each between marks that
name its role, and control strings inside roles and texts are escaped in a way that can be undone.

All of it is expressed over rows: the text of a turn is what follows its last opening, replacing or
emptying event, so turns fold apart from each other, and only the turns of one conversation are put
together, in order.

Defined cases: a null text is empty, a null role is the empty role; events of equal sequence are taken
in order of kind, role and text; rows that repeat are events of their own, and a repeated plain turn
is a turn of its own. A conversation with a null id is one conversation. An unknown kind of event is an
error. Other columns are ignored; an empty table gives no rows.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.llm.keys import columns_of
from flowspark.llm.words import slices

OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"
#: Control strings of this template and of other common ones. Fixed values.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escape(text):
    """Backslashes are doubled, and control strings are broken by one behind their first character."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescape(text):
    """The text before escape: of every backslash and the character behind it the latter is left."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def fold_events(events):
    """(conv_id, turn, role, text): the final message of every turn of the log.

    events has conv_id, seq, turn, kind (message, delta, edit, regenerate), role and text.
    """
    rows = columns_of(events, "conv_id", "seq", "turn", "kind", "role", "text")
    known = F.col("kind").isin("message", "delta", "edit", "regenerate")
    rows = rows.withColumn("kind", F.when(known, F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null"))))))
    turn = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text")
    rows = rows.withColumn("part", F.sum((F.col("kind") != "delta").cast("int")).over(turn))
    text = F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit("")))
    pieces = rows.select("conv_id", "turn", "seq", "kind", "role", "part", text.alias("text"))
    latest = Window.partitionBy("conv_id", "turn")
    pieces = pieces.withColumn("last", F.max("part").over(latest)).withColumn(
        "role", F.first("role", ignorenulls=True).over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "kind", "text")))
    return pieces.where("part = last").groupBy("conv_id", "turn").agg(
        F.first("role").alias("role"), F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))


def render(turns):
    """(conv_id, turn, role, text, formatted): every turn between its marks, escaped."""
    rows = columns_of(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # a line feed ends the role, so one inside it is escaped as well
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    return rows.withColumn("formatted", F.concat(F.lit(OPEN), role, F.lit(BETWEEN), escape(F.col("text")), F.lit(CLOSE)))


def conversations(turns):
    """(conv_id, formatted): the whole text of every conversation, for those that fit a row."""
    rows = render(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "formatted"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["formatted"]), "").alias("formatted"))


# Runs of plain characters are taken whole and never given back, so a very long turn needs no memory beside itself.
_TURN = re.compile(re.escape(OPEN) + r"([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n([^\\<]*+(?:(?:\\.|<(?!\|))[^\\<]*+)*+)"
                   + re.escape(CLOSE), re.S)


def parse(formatted):
    """(role, text, start and end of the text) of every turn of a formatted text."""
    at, out = 0, []
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("no turn where one should begin")
        out.append((unescape(found[1]), unescape(found[2]), found.start(2), found.end(2)))
        at = found.end()
    return out


def digests(turns):
    """Per conversation, read back from the formatted text: n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars.

    The turns of a conversation are streamed in order through running digests, whatever their number.
    """
    rendered = render(turns).select("conv_id", "turn", "role", "text", "formatted")
    kind = dict(rendered.dtypes)["conv_id"]
    dealt = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted")

    def fold(batches):
        now, state, done = None, None, []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def close():
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in slices(batches):
            for conv, formatted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == TRAINED:
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(formatted)
            ids = pa.array([d[0] for d in done], batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([d[k + 1] for d in done], t) for k, t in enumerate(kinds))], names=names)
            done.clear()
            id_type = batch.schema.field(0).type
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], id_type), *(pa.array([d[k + 1] for d in done], t) for k, t in enumerate(kinds))], names=names)

    return dealt.mapInArrow(fold, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(turns):
    """Plain rows by turn as a log: one message event each; rows that share a turn stay apart."""
    rows = columns_of(turns, "conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return rows.select("conv_id", F.col("turn").alias("seq"), F.struct("turn", F.row_number().over(order).alias("copy")).alias("turn"),
                       F.lit("message").alias("kind"), "role", "text")


def format_log(turns):
    """The digests of all conversations, through the event log."""
    return digests(fold_events(as_events(turns)))


def _sql():
    escaped = r"regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(\||/?s>|<SYS>>|</SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"
    text, role = escaped.format("text"), escaped.format("role")
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
f AS (SELECT *, '{OPEN}' || replace({role}, chr(10), '\' || chr(10)) || chr(10) || {text} || '<|im_end|>' || chr(10) AS formatted FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


SQL = _sql()
