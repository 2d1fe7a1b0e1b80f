"""Chat formatting by event-sourced reconstruction (operator 9), with DataFrame functions alone.

An event log holds, for each conversation and in the order of ``seq``:

* ``message``: opens a message with its ``role`` and a first ``text``;
* ``delta``: adds ``text`` to it;
* ``edit``: puts ``text`` in place of all it held;
* ``regenerate``: empties it, for the deltas that follow, and takes away the messages that were opened after it.

``msg`` names the message within the conversation. The template writes ``<|start|>role<|text|>text<|end|>`` and a newline
for each message. Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so none can hold a mark, and
reading back gives each as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
LEARNED_ROLE = "assistant"
KINDS = ("message", "regenerate", "edit", "delta")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def reconstruct(events: DataFrame) -> DataFrame:
    """``conv_id, seq, msg, kind, role, text`` to final messages ``conv_id, msg, opened, role, text``.

    opened: the seq of a message's first event, which orders the messages. A null text adds nothing, a null role is
    empty. Events of equal seq are taken in the order of KINDS, then text. Events of other kinds, and messages whose
    first event doesn't open them, are left out. Rows with a null conv_id make up one conversation. No events give no
    rows. Messages are folded each by itself, so a conversation's length bounds no array here.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    event = F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    logs = events.where(F.col("kind").isin(*KINDS)).groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(event)).alias("log"))
    restart = F.array_max(F.transform("log", lambda e, i: F.when(e["rank"] < len(KINDS), i)))
    kept = F.slice("log", F.coalesce(restart, F.lit(0)) + 1, F.size("log"))
    first = F.get("log", F.lit(0))
    messages = logs.where(first["rank"] == 1).select(
        "conv_id",
        "msg",
        first["seq"].alias("opened"),
        first["role"].alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
        F.array_max(F.transform(F.filter("log", lambda e: e["rank"] == 2), lambda e: e["seq"])).alias("regenerated"),
    )
    before = W.partitionBy("conv_id").orderBy("opened", "msg").rowsBetween(W.unboundedPreceding, -1)
    last = messages.withColumn("last", F.max("regenerated").over(before))
    return last.where("last is null or last < opened").select("conv_id", "msg", "opened", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, opened, msg, role, text`` to ``conv_id, formatted, turn_starts, loss_spans``.

    turn_starts: where each turn begins in ``formatted``, in code points. loss_spans: of each turn the start and length
    of what counts for the loss: an assistant's text; length 0 for others. Null roles and texts are empty; messages of
    equal place are taken in the order of msg, role, text, repeated ones each; no messages give no rows. A conversation
    is one row, so its whole text goes through one task.
    """
    head = F.concat(F.lit(START), escaped(F.coalesce("role", F.lit(""))), F.lit(TEXT))
    body = escaped(F.coalesce("text", F.lit("")))
    along = W.partitionBy("conv_id").orderBy("opened", "msg", "piece").rowsBetween(W.unboundedPreceding, -1)
    size = F.when(F.col("role") == LEARNED_ROLE, F.length(body)).otherwise(0)
    pieces = messages.select("conv_id", "opened", "msg", F.concat(head, body, F.lit(END + "\n")).alias("piece"), F.length(head).cast("long").alias("skip"), size.cast("long").alias("size"))
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(along), F.lit(0)).cast("long"))
    loss = F.struct((F.col("start") + F.col("skip")).alias("start"), F.col("size").alias("length"))
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("opened", "msg", "piece", "start", loss.alias("loss")))).alias("turns"))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["start"]).alias("turn_starts"),
        F.transform("turns", lambda t: t["loss"]).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """``formatted, turn_starts, loss_spans`` to ``conv_id, turns array<struct<role, text>>, learned array<string>, formatted``.

    learned: what the loss spans that aren't empty cut out of ``formatted``, unescaped. A null ``formatted`` gives nulls;
    an empty table gives no rows.
    """
    pieces = F.slice(F.split("formatted", r"<\|start\|>"), 2, 1 << 30)
    turns = F.transform(pieces, lambda p: F.struct(unescaped(F.substring_index(p, TEXT, 1)).alias("role"), unescaped(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))
    marked = F.arrays_zip(pieces.alias("piece"), F.col("turn_starts").alias("at"), F.col("loss_spans").alias("loss"))
    cut = F.transform(
        F.filter(marked, lambda m: m["loss"]["length"] > 0),
        lambda m: unescaped(F.substring(m["piece"], (m["loss"]["start"] - m["at"] - len(START) + 1).cast("int"), m["loss"]["length"].cast("int"))),
    )
    return rendered.select("conv_id", turns.alias("turns"), cut.alias("learned"), "formatted")


#: A conversation whose texts hold other templates' marks.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


#: Code points of a delta of the derived log.
DELTA = 24


def derived_log(turns: DataFrame) -> DataFrame:
    """``conv_id, msg, role, text`` (msg: 1, 2, ... in order) to an event log that ends in just these messages.

    As a chat front end would have written it: texts come in as deltas of DELTA characters; every third message is first
    a draft and edited at last; every fourth is first answered otherwise, has a successor, and is generated again, which
    takes the successor away. Events of other conversations lie between; only ``seq`` orders a conversation's.
    """
    n = F.col("msg")
    text = F.coalesce("text", F.lit(""))
    regenerated, edited = n % 4 == 3, n % 3 == 2

    def event(at, kind: str, said, msg=n, role=None) -> Column:
        role = F.col("role") if role is None else F.lit(role)
        return F.struct(F.lit(at).cast("long").alias("at"), msg.cast("long").alias("msg"), F.lit(kind).alias("kind"), role.alias("role"), said.alias("text"))

    size = F.length(text)
    deltas = F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(size / DELTA).cast("int"), F.lit(1))), lambda i: event(i + 10, "delta", F.substring(text, (i - 1) * DELTA + 1, F.lit(DELTA)), role=""))
    draft = F.concat(F.lit("draft of "), F.substring(text, 1, DELTA))
    successor = -n  # an id of its own
    before = F.array(
        event(0, "message", F.when(regenerated, draft).otherwise(F.lit(None).cast("string"))),
        event(1, "delta", F.when(regenerated, F.lit(" and more")), role=""),
        event(2, "message", F.when(regenerated, F.lit("gone ")), successor, "user"),
        event(3, "delta", F.when(regenerated, F.lit("soon")), successor, ""),
        event(4, "regenerate", F.when(regenerated, F.lit(None).cast("string")), role=""),
    )
    kept = F.filter(before, lambda e: (e["at"] == 0) | regenerated)
    edit = F.when(edited, F.array(event(11, "delta", draft, role=""), event(12, "edit", text, role=""))).otherwise(deltas)
    log = turns.select("conv_id", "msg", F.explode(F.concat(kept, edit)).alias("e"))
    # a message's events follow those of the one before; no message has 2^32 of them
    return log.select("conv_id", (n * (1 << 32) + F.col("e.at")).alias("seq"), "e.msg", "e.kind", "e.role", "e.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(row, ("conv_id", "turn", "role", "text"), strict=True))) for row in PROBE))))
    logs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    numbered = logs.withColumn("msg", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    read = read_back(stored(render(reconstruct(derived_log(numbered)))))
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('{START}' || {_ESCAPED.format("role")} || '{TEXT}' || {_ESCAPED.format("text")} || '{END}' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
