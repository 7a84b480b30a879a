"""Chat formatting by quotation linking. Lines that begin with '>' may be quotes, as deep as there are signs. Neighbouring lines of one depth are a
passage; passages are normalised and hashed, whole, by paragraph and by line, and joined to what earlier messages of the conversation say themselves. What
is found there is a quote and goes; what nobody said before (code, a proverb) stays where it is, with its signs. A message replies to the message it quotes, at the
least depth and with the most text; without a quote that is found, to the message before it. A message that replies to any but the one before it begins a
branch. Messages come out without quotes, with their branch, their place there, and their place in the conversation in order of replies: a branch as
a whole, then the branches that answer its messages, those of later messages first, so that no message comes before the one it answers.

Numbers along a conversation come from sums by stretches of turns and sums of these, and the order of branches from pointers that are doubled, so that no
task holds a whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

#: Turns in one stretch.
STRETCH = 4096

MARK = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
WROTE = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|.{1,100} (?:wrote|writes|said)|-{2,} ?original message ?-{2,})\s*:?\s*$", re.I)
PLAIN = re.compile(r"\W+")


def hashed(part: str, signs: bool) -> tuple[int, int] | None:
    """Hash and letters of a text's letters and digits in lower case; of one without any, of its signs, if these count."""
    plain = PLAIN.sub("", part).lower() or ("".join(part.split()) if signs else "")
    return (xxhash.xxh3_64_intdigest(plain) - (1 << 63), len(plain)) if plain else None


def parts(lines: list[str]) -> Iterator[tuple[int, int]]:
    """First and last of the lines of a text as a whole, of its paragraphs and of its lines."""
    seen = set()
    begin = 0
    for k in range(len(lines) + 1):
        if k == len(lines) or not lines[k].strip():
            if begin < k:
                seen.add((begin, k - 1))
            begin = k + 1
        else:
            seen.add((k, k))
    yield from sorted(seen | {(0, len(lines) - 1)})


def said(lines: list[str]) -> list[int]:
    """Hashes of what a message says itself."""
    got = {hashed("\n".join(lines[a : b + 1]), True) for a, b in parts(lines)} if lines else set()
    return sorted({x[0] for x in got if x})


def parsed(text: str) -> tuple[list[str], list[tuple[int, int, int, int, int]], int]:
    """The lines that neither are marked nor announce such; of each part of a passage its depth, hash, letters, and first and last line in the text, with the line that
    announces it; the number of passages. A part without letters or digits is told by its signs only where it is a whole passage."""
    lines = text.split("\n")
    marked, announcing = set(), set()
    passages: list[tuple[int, int, list[str], list[int]]] = []  # depth, first line to go with it, lines, their places
    level = 0
    for k, line in enumerate(lines):
        if not (m := MARK.match(line)):
            level = 0
            continue
        marked.add(k)
        depth = m[1].count(">")
        if depth != level:
            begin = k
            if level == 0:
                above = k - 1
                while above >= 0 and not lines[above].strip():
                    above -= 1
                if above >= 0 and above not in marked and WROTE.match(lines[above]):
                    begin = above
                    announcing.add(above)
            elif WROTE.match(passages[-1][2][-1]):
                passages[-1][2].pop()
                begin = passages[-1][3].pop()
            passages.append((depth, begin, [], []))
        level = depth
        passages[-1][2].append(line[m.end() :])
        passages[-1][3].append(k)
    out = []
    for depth, begin, body, at in passages:
        for a, b in parts(body) if body else ():
            if h := hashed("\n".join(x for x in body[a : b + 1] if not WROTE.match(x)), (a, b) == (0, len(body) - 1)):
                out.append((depth, *h, at[a] if a else begin, at[b]))
    return [x for k, x in enumerate(lines) if k not in marked and k not in announcing], out, len(passages)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these lines, marked lines without words beside them, blank lines at its ends, and more than one where a quote went."""
    if not spans:
        return text
    gone = {k for a, b in spans for k in range(a, b + 1)}
    lines = text.split("\n")
    bare = {k for k, x in enumerate(lines) if (m := MARK.match(x)) and not x[m.end() :].strip()}
    for k in sorted(bare):
        if k - 1 in gone:
            gone.add(k)
    for k in sorted(bare, reverse=True):
        if k + 1 in gone:
            gone.add(k)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for k, x in enumerate(lines) if k not in gone)).strip("\n")


PARSED = "text string, key bigint, said array<bigint>, quotes array<struct<depth:int,hash:bigint,letters:int,first:int,last:int>>, n_quotes int"


def parse(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("depth", pa.int32()), ("hash", pa.int64()), ("letters", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
        names = ["depth", "hash", "letters", "first", "last"]
        for batch in batches:
            own, quotes, n = [], [], []
            for t in batch.column("text").to_pylist():
                lines, found, passages = parsed(t) if t is not None else ([], [], 0)
                own.append(said(lines))
                quotes.append([dict(zip(names, x)) for x in found])
                n.append(passages)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int64())), pa.array(quotes, kind), pa.array(n, pa.int32())], names=["conv_id", "turn", "role", "text", "key", "said", "quotes", "n_quotes"])

    text = F.col("text").cast("string")
    slim = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"), F.xxhash64(text).alias("key"))
    return slim.mapInArrow(run, "conv_id bigint, turn bigint, role string, " + PARSED)


def stretch() -> F.Column:
    return F.floor(F.col("turn") / STRETCH)


def links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, key, depth, letters, first, last, quoted): parts of messages that an earlier message says, with the last turn that does."""
    asks = rows.where("n_quotes > 0").select("conv_id", "turn", "key", F.explode("quotes").alias("q")).select("conv_id", "turn", "key", "q.*").distinct()
    own = rows.join(asks.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode("said").alias("hash"))
    own = own.join(asks.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    null = lambda kind: F.lit(None).cast(kind)
    both = asks.withColumn("at", null("long")).unionByName(own.withColumn("at", F.col("turn")), allowMissingColumns=True).withColumn("stretch", stretch())
    both = written(both, "said")
    # the last turn of each stretch that says it, and of the stretches before
    per = both.groupBy("conv_id", "hash", "stretch").agg(F.max("at").alias("_m"))
    before = W.partitionBy("conv_id", "hash").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("conv_id", "hash", "stretch", F.max("_m").over(before).alias("_before"))
    within = W.partitionBy("conv_id", "hash", "stretch").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    found = both.withColumn("_own", F.max("at").over(within)).where("depth is not null").join(per, ["conv_id", "hash", "stretch"])
    return found.withColumn("quoted", F.coalesce("_own", "_before")).where("quoted is not null").select("conv_id", "turn", "key", "depth", "letters", "first", "last", "quoted")


def _sums(table_: DataFrame, what: str) -> DataFrame:
    """(conv_id, stretch, before): the sum of what in all earlier stretches of the conversation."""
    per = table_.groupBy("conv_id", "stretch").agg(F.sum(what).alias("_s"))
    w = W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    return per.select("conv_id", "stretch", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("before"))


def doubled(nodes: DataFrame, told: F.Column) -> DataFrame:
    """nodes (conv_id, branch, to, own), with `to` followed to its end: own is replaced by told, of own and the next one's `further`, until none has a `to`."""
    while nodes.where("`to` is not null").limit(1).count():
        ahead = nodes.select("conv_id", F.col("branch").alias("to"), F.col("to").alias("_to"), F.col("own").alias("further"))
        nodes = written(nodes.join(ahead, ["conv_id", "to"], "left").select("conv_id", "branch", F.col("_to").alias("to"), F.when(F.col("to").isNull(), F.col("own")).otherwise(told).alias("own")), "pointers")
    return nodes


def begins(branches: DataFrame) -> DataFrame:
    """(conv_id, branch, begin): messages before a branch's first one in order of replies. branches: conv_id, branch, parent, at (place in the parent), n (messages)."""
    siblings = W.partitionBy("conv_id", "parent").orderBy(F.desc("at"), "branch")
    own = written(branches.withColumn("sibling", F.when(F.col("parent").isNotNull(), F.lead("branch").over(siblings))), "branches")
    firsts = own.where("parent is not null").groupBy("conv_id", F.col("parent").alias("branch")).agg(F.min_by("branch", F.struct(-F.col("at"), "branch")).alias("child"))
    # up to the nearest one that has a later sibling
    up = doubled(own.select("conv_id", "branch", F.when(F.col("sibling").isNull(), F.col("parent")).alias("to"), F.col("branch").alias("own")), F.col("further"))
    later = up.join(own.select("conv_id", F.col("branch").alias("own"), "sibling"), ["conv_id", "own"]).select("conv_id", "branch", "sibling")
    after = later.join(firsts, ["conv_id", "branch"], "left").join(own.select("conv_id", "branch", "n"), ["conv_id", "branch"]).select("conv_id", F.coalesce("child", "sibling").alias("next"), F.col("branch").alias("to"), "n").where("next is not null")
    before = own.select("conv_id", "branch").join(after.withColumnRenamed("next", "branch"), ["conv_id", "branch"], "left")
    ranked = doubled(written(before.select("conv_id", "branch", "to", F.coalesce("n", F.lit(0)).cast("long").alias("own")), "pointers"), F.col("own") + F.col("further"))
    return ranked.select("conv_id", "branch", F.col("own").alias("begin"))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), reply_to (a turn; null for a first message), quoted (is it told by a quote?), n_quotes (passages that are marked), branch (from 0), position
    (from 0 in the branch), place (from 0 in the conversation, in order of replies). A null text stays null and quotes nothing; rows of one conversation and turn
    share reply, branch, position and place, each losing its own quotes; rows without conversation or turn get none and keep their texts; an empty table gives no rows."""
    rows = written(parse(messages), "messages")
    found = written(links(rows.where("conv_id is not null and turn is not null")), "links")
    per = found.groupBy("conv_id", "turn", "depth", "quoted").agg(F.sum("letters").alias("letters"))
    replies = per.groupBy("conv_id", "turn").agg(F.max_by("quoted", F.struct(-F.col("depth"), "letters", "quoted")).alias("quoted"))
    turns = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct().withColumn("stretch", stretch())
    turns = written(turns.join(replies, ["conv_id", "turn"], "left"), "turns")
    within = W.partitionBy("conv_id", "stretch").orderBy("turn")
    ends = turns.groupBy("conv_id", "stretch").agg(F.max("turn").alias("_m"))
    ends = ends.select("conv_id", "stretch", F.lag("_m").over(W.partitionBy("conv_id").orderBy("stretch")).alias("_end"))
    told = turns.join(ends, ["conv_id", "stretch"]).withColumn("previous", F.coalesce(F.lag("turn").over(within), "_end")).drop("_end")
    told = told.withColumn("reply_to", F.coalesce("quoted", "previous")).withColumn("begins", F.coalesce((F.col("reply_to") != F.col("previous")).cast("int"), F.lit(0)))
    told = told.withColumn("one", F.lit(1))
    for what, name in (("begins", "branch"), ("one", "number")):
        told = told.withColumn("_own", F.sum(what).over(within)).join(_sums(told, what), ["conv_id", "stretch"]).withColumn(name, (F.col("_own") + F.col("before")).cast("long")).drop("_own", "before")
    told = written(told.select("conv_id", "turn", "reply_to", F.col("quoted").isNotNull().alias("quoted"), "branch", "number"), "numbered")
    firsts = told.groupBy("conv_id", "branch").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"), F.min_by("reply_to", "number").alias("answers"))
    told = told.join(firsts.select("conv_id", "branch", "first"), ["conv_id", "branch"]).withColumn("position", F.col("number") - F.col("first"))
    # branches of conversations that have several
    several = firsts.where("branch > 0").select("conv_id").distinct()
    parents = told.select("conv_id", F.col("turn").alias("answers"), F.col("branch").alias("parent"), F.col("position").alias("at"))
    branches = firsts.join(several, "conv_id", "left_semi").withColumn("answers", F.when(F.col("branch") > 0, F.col("answers"))).join(parents, ["conv_id", "answers"], "left").select("conv_id", "branch", "parent", "at", "n")
    branches = written(branches, "branches")
    if branches.limit(1).count():
        told = told.join(begins(branches), ["conv_id", "branch"], "left").withColumn("place", F.coalesce("begin", F.lit(0)) + F.col("position"))
    else:
        told = told.withColumn("place", F.col("position"))
    told = told.select("conv_id", "turn", "reply_to", "quoted", "branch", "position", "place")
    gone = found.groupBy("conv_id", "turn", "key").agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    out = rows.select("conv_id", "turn", "role", "text", "key", "n_quotes").join(told, ["conv_id", "turn"], "left").join(gone, ["conv_id", "turn", "key"], "left")
    names = ["conv_id", "turn", "role", "text", "reply_to", "quoted", "n_quotes", "branch", "position", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if g is None or t is None else cut(t, [(x["first"], x["last"]) for x in g]) for t, g in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    kinds = "conv_id bigint, turn bigint, role string, text string, reply_to bigint, quoted boolean, n_quotes bigint, branch bigint, position bigint, place bigint"
    return out.select(*[F.col(n).cast("bigint") if n == "n_quotes" else F.col(n) for n in names], "gone").mapInArrow(run, kinds)


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))
