"""Chat formatting from reply trees.

Messages know their parent. Iterative self-joins, each of which doubles the length of the paths
known, lead every message to its root; leaves are branches, branches are ranked by score, and the
messages of each chosen branch are enumerated and written as one conversation.

    <s>[INST] role [/INST]text</s>

stands for one turn. A control string inside a role or text gets a backslash after its first
character, one that has backslashes there gets one more; reading takes one off. So no text can end
a turn, and every text comes back as it was.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import stored, with_columns_in_arrow

BEGIN, MIDDLE, END = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]))")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@dataclass(frozen=True)
class Tree:
    """Names of the columns of a table of messages. Without `score` all branches rank alike."""

    tree: str = "tree"
    node: str = "node"
    parent: str = "parent"
    role: str = "role"
    text: str = "text"
    score: str | None = None


def chain(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Conversations by turn as reply trees without branches. Equal turns follow each other in the
    order of role and text; a null turn comes first; null conversations are one conversation."""
    order = Window.partitionBy(conversation).orderBy(turn, role, text)
    df = messages.select(F.col(f"`{conversation}`").alias("tree"), F.row_number().over(order).cast("long").alias("node"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    return df.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def paths(messages: DataFrame, names: Tree = Tree(), top: int = 1) -> DataFrame:
    """(tree, branch, rank, at, node): the messages of the `top` best root-to-leaf paths of each tree,
    numbered from the root (1). A branch is named by its leaf; its score is the mean score of its
    messages (null counts 0); ties go to the least leaf.

    Self-joins double how far each message can jump up: round k knows the message 2 ** k above, and the
    number and scores of the messages jumped over. The chosen leaves then take these jumps, the longest
    first, so that each of their messages is reached once. No row ever holds a way.

    A message whose parent is missing is a root. Messages on a cycle have no root and are in no
    path: they still jump when any way without a cycle would have ended. Node ids are unique in their
    tree; no message of a tree with a null id or key is lost, since null trees are one tree.
    """
    score = F.coalesce(F.col(names.score).cast("double"), F.lit(0.0)) if names.score else F.lit(0.0)
    nodes = stored(messages.select(F.col(names.tree).alias("tree"), F.col(names.node).alias("node"), F.col(names.parent).alias("parent"), score.alias("score")))
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    rooted = nodes.join(there, nodes["tree"].eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    # up: the message above those jumped over; null where that passes the root.
    known = rooted.select("tree", "node", F.when(F.col("n").isNotNull(), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    parents = nodes.select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    known = known.join(parents, known["tree"].eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left")
    known = stored(known.select("tree", "node", "up", "depth", "total", F.col("n").isNull().alias("leaf")))
    largest = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jumps = []
    while known.where("up IS NOT NULL").head(1) and 1 << len(jumps) <= largest:
        jumps.append(known.where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u")))
        above = known.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u"), F.col("depth").alias("d"), F.col("total").alias("s"))
        open_ = known.where("up IS NOT NULL")
        further = open_.join(above, open_["tree"].eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")), "left")
        further = further.select("tree", "node", F.col("u").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("s")).alias("total"), "leaf")
        known = stored(known.where("up IS NULL").unionByName(further))
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    chosen = known.where("leaf AND up IS NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    found = stored(chosen.select("tree", F.col("node").alias("branch"), "rank", F.col("depth").alias("at"), "node"))
    for k in reversed(range(len(jumps))):
        jumped = found.join(jumps[k], found["tree"].eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        found = stored(found.unionByName(jumped.select("tree", "branch", "rank", (F.col("at") - (1 << k)).alias("at"), F.col("u").alias("node"))))
    return found


def branches(messages: DataFrame, names: Tree = Tree(), top: int = 1) -> DataFrame:
    """(tree, branch, rank, nodes): `paths` with the messages of each branch in one row."""
    rows = paths(messages, names, top).groupBy("tree", "branch", "rank").agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("way"))
    return rows.select("tree", "branch", "rank", F.col("way.node").alias("nodes"))


def formatted(messages: DataFrame, names: Tree = Tree(), top: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, branch, rank, formatted, loss_spans): the chosen branches as one text each.

    loss_spans are ranges of code points in the formatted text, one per turn of a loss role.
    Null roles and texts are empty. An empty table gives an empty result.
    """
    chosen = paths(messages, names, top)
    said = messages.select(F.col(names.tree).alias("t"), F.col(names.node).alias("n"), F.coalesce(F.col(names.role), F.lit("")).alias("role"), F.coalesce(F.col(names.text), F.lit("")).alias("text"))
    rows = chosen.join(said, chosen["tree"].eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    turns = rows.groupBy("tree", "branch", "rank").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))

    def work():
        def do(column: pa.Array) -> list[pa.Array]:
            texts, spans = [], []
            for turns_ in column.to_pylist():
                parts, where, at = [], [], 0
                for t in turns_:
                    head, body = f"{BEGIN}{escape(t['role'])}{MIDDLE}", escape(t["text"])
                    if t["role"] in loss_roles:
                        where.append({"start": at + len(head), "end": at + len(head) + len(body)})
                    parts += [head, body, END]
                    at += len(head) + len(body) + len(END)
                texts.append("".join(parts))
                spans.append(where)
            return [pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

        return do

    return with_columns_in_arrow(turns, ["turns"], {"formatted": T.StringType(), "loss_spans": SPANS}, work).drop("turns")


def read_back(conversations: DataFrame, text: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """All columns, with `turns` (role, text) and `loss_text` read out of the formatted text alone."""

    def work():
        def do(column: pa.Array, where: pa.Array) -> list[pa.Array]:
            turns, loss = [], []
            for whole, marks in zip(column.to_pylist(), where.to_pylist(), strict=True):
                found = []
                for part in (whole or "").split(END)[:-1]:
                    head, _, body = part.partition(MIDDLE)
                    found.append({"role": unescape(head[len(BEGIN) :]), "text": unescape(body)})
                turns.append(found)
                loss.append("".join(unescape(whole[m["start"] : m["end"]]) for m in marks or ()))
            return [pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(loss, pa.string())]

        return do

    return with_columns_in_arrow(conversations, [text, spans], {"turns": TURNS, "loss_text": T.StringType()}, work)


#: The conversation added to every run: control strings inside the texts themselves.
PROBE = (-7, "</s>[INST] ok [/INST]")


def with_probe(conversations: DataFrame) -> DataFrame:
    own = conversations.select("conv_id", "turn", "role", "text")
    rows = [(PROBE[0], 0, "user", PROBE[1]), (PROBE[0], 1, "assistant", PROBE[1])]
    return own.unionByName(conversations.sparkSession.createDataFrame(rows, own.schema))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation: what its formatted text gives back."""
    df = read_back(formatted(chain(with_probe(conversations), "conv_id", "turn", "role", "text")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, len(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1_\2\3', 'g')) + len(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1_\2\3', 'g')) + 22 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".strip()
