"""Phrase collocations from a weighted de Bruijn graph: longest grams are edges between overlapping nodes, shorter counts are node flows."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, maybe_broadcast, stored, table

LONGEST, LEAST, COVERED, FIRST = 3, 10, 50, 2000
#: Words that a worker counts together, and distinct words it numbers before it starts anew.
FLUSH, NUMBERED = 1 << 22, 1 << 20
#: Documents sampled for nodes that hold more than a WIDEth of all edges, and tasks that such a node is dealt to.
SAMPLE, WIDE, SALTS = 5000, 2000, 64
#: Grams of an Arrow batch, and edges of a row of a compacted path.
OUT_ROWS, PATH = 20_000, 1024
_MARKS = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


class _Numbers(dict):
    """Numbers of words from 1 in the order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def pieces(text: str | None) -> list[list[bytes]]:
    """The words `[^\\x20\\x09]+` of each piece between marks and line ends, A-Z lower-cased; bytes.split() knows ASCII white space only."""
    return [ws for ws in map(bytes.split, text.encode("utf-8", "replace").translate(_MARKS).split(b"\n")) if ws] if text else []


def _grams(longest: int):
    """(lang, gram, n): at each word the edge that starts there, the longest gram; near a piece's end a node alone, or a shorter gram."""

    def counted(streams: dict[str, array], numbers: _Numbers):
        words = pa.array(list(numbers), pa.binary()).cast(pa.string())
        for lang, stream in streams.items():
            s = np.concatenate([np.frombuffer(stream, np.int32), np.zeros(longest, np.int32)])
            cols = [s[i : len(s) - longest + i].copy() for i in range(longest)]
            for i in range(1, longest):  # nothing beyond a piece's end
                cols[i][cols[i - 1] == 0] = 0
            starts = cols[0] > 0
            order = np.lexsort([c[starts] for c in cols[::-1]])
            cols = [c[starts][order] for c in cols]
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(order)))
            for a in range(0, len(at), OUT_ROWS):
                some = [c[at[a : a + OUT_ROWS]] for c in cols]
                texts = [words.take(pa.array(c - 1, mask=c == 0)) for c in some]
                gram = pc.binary_join_element_wise(*texts, " ", null_handling="skip")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), gram, pa.array(n[a : a + OUT_ROWS], pa.int64())], ["lang", "gram", "n"])

    def run(batches):
        streams, numbers, held = {}, _Numbers(), 0
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream = streams.setdefault(lang, array("i"))
                before = len(stream)
                for ws in pieces(text):
                    stream.extend(map(numbers.__getitem__, ws))
                    stream.append(0)
                held += len(stream) - before
                if held >= FLUSH or len(numbers) >= NUMBERED:
                    yield from counted(streams, numbers)
                    streams, numbers, held = {}, _Numbers(), 0
        yield from counted(streams, numbers)
        pa.default_memory_pool().release_unused()

    return run


def part(gram: Column | str, first: int) -> Column:
    """The first words of a gram, or with a negative number its last ones."""
    return F.substring_index(gram, " ", first)


def words(gram: Column | str) -> Column:
    """How many words a gram has; a space stands between each two."""
    return (F.length(gram) - F.length(F.replace(gram, F.lit(" "))) + 1).cast("tinyint")


def _wide(grams: DataFrame, longest: int) -> DataFrame:
    """(lang, node, wide): nodes with more than a WIDEth of all edges that a task has counted, WIDE of them at most."""
    nodes = stored(grams.groupBy("lang", part("gram", longest - 1).alias("node")).agg(F.count(F.lit(1)).alias("n")))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    found = nodes.where(F.col("n") * WIDE > total).select("lang", "node").collect()
    return grams.sparkSession.createDataFrame([(*r, True) for r in found], "lang string, node string, wide boolean")


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, gram, words, n): all words, and the grams of 2 to `longest` words that stand `least` times or more.

    Edges, the grams of `longest` words, are aggregated over all texts and are dealt once, by the node they leave, so that a node's
    flow is summed where its edges are: what leaves it by edges, plus the pieces that end in it. Each level is summed
    from the one above; grams that are frequent go along. Nodes that very many edges leave are dealt by edge to SALTS tasks and
    meet on the next level; a sample of texts says which ones, which decides nothing but the tasks' sizes.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    grams = lambda df: df.mapInArrow(_grams(longest), "lang string, gram string, n long")
    wide = _wide(grams(texts.sample(min(1.0, SAMPLE / max(1, docs.count())), seed=7)), longest)
    node = part("gram", longest - 1)  # of a shorter gram itself
    told = grams(texts).join(F.broadcast(wide.withColumnRenamed("lang", "its")), (F.col("lang") == F.col("its")) & (node == F.col("node")), "left")
    salt = F.when(F.col("wide"), F.pmod(F.xxhash64("gram"), F.lit(SALTS))).otherwise(-1).cast("int")
    dealt = told.select("lang", "gram", "n", salt.alias("salt")).repartition("lang", node, "salt")
    edges = dealt.withColumn("node", node).groupBy("lang", "node", "salt", "gram").agg(F.sum("n").alias("n"))
    row = lambda gram, words: F.struct(gram.alias("gram"), words.cast("tinyint").alias("words"), F.col("n").alias("n"))
    of_node = row(F.col("node"), words("node"))
    level = F.when((F.col("gram") != F.col("node")) & (F.col("n") >= least), F.array(row(F.col("gram"), F.lit(longest)), of_node)).otherwise(F.array(of_node))
    held = edges.select("lang", "node", "salt", F.explode(level).alias("e")).select("lang", "node", "salt", "e.*").groupBy("lang", "node", "salt", "gram", "words").agg(F.sum("n").alias("n"))
    for size in range(longest - 1, 1, -1):
        whole, first = row(F.col("gram"), F.col("words")), row(part("gram", size - 1), F.lit(size - 1))
        frequent = (F.col("n") >= least) | (F.col("salt") >= 0)
        level = F.when((F.col("words") == size) & frequent, F.array(whole, first)).when(F.col("words") == size, F.array(first)).otherwise(F.array(whole))
        held = held.select("lang", F.explode(level).alias("e")).select("lang", "e.*").groupBy("lang", "gram", "words").agg(F.sum("n").alias("n")).withColumn("salt", F.lit(-1))
    return held.groupBy("lang", "gram", "words").agg(F.sum("n").alias("n")) if longest == 2 else held.drop("salt")


def paths(grams: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Edges (lang, gram, n) of counts() with path, place, head, tail: `path` is the first edge of the unary path that the edge lies on.

    An edge goes on to the next if it is all that enters the node between, and the next all that leaves it: both then have the
    node's count, so no piece starts or ends there. head and tail say whether the edge's first and last node are ends
    of the path. Paths have no cycles, as each walk starts somewhere. They are found by doubling: in each round an edge
    skips as far as the one it points to did.
    """
    edges = stored(grams.where(F.col("words") == longest).select("lang", "gram", "n", F.monotonically_increasing_id().alias("e")))
    nodes = grams.where(F.col("words") == longest - 1).select("lang", F.col("gram").alias("node"), F.col("n").alias("flow"))
    whole = lambda end, name: edges.withColumn("node", part("gram", end)).join(nodes, ["lang", "node"]).where("n = flow").select("lang", "node", F.col("e").alias(name))
    links = stored(whole(1 - longest, "before").join(whole(longest - 1, "e"), ["lang", "node"]).select("e", "before"))
    done = edges.join(links, "e", "left_anti").select("e", F.col("e").alias("path"), F.lit(0).cast("long").alias("place"))
    done, open_ = checkpoint(done), checkpoint(links.select("e", F.col("before").alias("to"), F.lit(1).cast("long").alias("step")))
    while not open_.isEmpty():
        met = open_.join(done.select(F.col("e").alias("to"), "path", "place"), "to")
        ended = met.select("e", "path", (F.col("place") + F.col("step")).alias("place"))
        skips = open_.select(F.col("e").alias("to"), F.col("to").alias("beyond"), F.col("step").alias("further"))
        open_ = checkpoint(open_.join(skips, "to").select("e", F.col("beyond").alias("to"), (F.col("step") + F.col("further")).alias("step")))
        done = checkpoint(done.unionByName(ended))
    befores = links.select(F.col("before").alias("e"), F.lit(False).alias("tail"))
    found = edges.join(done, "e").join(befores, "e", "left")
    return found.select("lang", "gram", "n", "path", "place", (F.col("place") == 0).alias("head"), F.coalesce("tail", F.lit(True)).alias("tail"))


def compacted(found: DataFrame) -> DataFrame:
    """(lang, path, block, n, text): the unary paths, each with its words in order, up to PATH edges a row."""
    block = F.floor(F.col("place") / PATH)
    steps = F.array_sort(F.collect_list(F.struct("place", "gram")))
    words = F.concat(F.array(steps[0]["gram"]), F.transform(F.slice(steps, 2, PATH), lambda s: part(s["gram"], -1)))
    return found.groupBy("lang", "path", block.alias("block")).agg(F.max("n").alias("n"), F.array_join(words, " ").alias("text"))


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)) of columns of whole numbers below 10**15, whose products take up to 38 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(15,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to `longest` words.

    docs: text, lang. A phrase that stands `least` times is scored at its weakest cut; one that lies in a longer
    candidate with `covered` % of its occurrences or more is dropped. Nodes inside a unary path have the path's own count, so
    they are dropped without a look; the nodes at its ends ask the path's first and last edge. Products are decimals
    of 38 digits, exact for counts below 10**15.
    Null texts are empty; null languages are `und`; texts are read whole; repeated rows count each; an empty table gives
    no rows; other columns, and their names, play no part.
    """
    grams = stored(counts(docs, longest, least))
    key = ["lang", "gram"]
    candidates = grams.where((F.col("words") > 1) & (F.col("n") >= least))
    longer = candidates.where(F.col("words") > 2)
    ends = stored(paths(grams, longest))
    inner = F.when(~F.col("head") & ~F.col("tail"), F.array()).when(~F.col("head"), F.array(part("gram", 1 - longest))).when(~F.col("tail"), F.array(part("gram", longest - 1))).otherwise(F.array(part("gram", longest - 1), part("gram", 1 - longest)))
    top = ends.select("lang", "n", F.explode(inner).alias("gram"))
    below = longer.where(F.col("words") < longest).select("lang", "n", F.explode(F.array(F.expr("substring_index(gram, ' ', words - 1)"), F.expr("substring_index(gram, ' ', 1 - words)"))).alias("gram"))
    over = top.unionByName(below).groupBy(*key).agg(F.max("n").alias("over"))
    inside = ends.where(~F.col("tail")).select("lang", part("gram", 1 - longest).alias("gram"))
    kept = candidates.join(inside, key, "left_anti").join(over, key, "left").where(F.coalesce(100 * F.col("over") < covered * F.col("n"), F.lit(True)))
    kept = stored(kept.select("lang", "gram", "words", F.col("n").alias("a")))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(gram, ' ', k)")).withColumn("right", F.expr("substring_index(gram, ' ', k - words)"))
    known = stored(grams.where(F.col("n") >= least).select("lang", "gram", "n"))
    rows = known.count()
    of = lambda side, name: maybe_broadcast(known.select("lang", F.col("gram").alias(side), F.col("n").alias(name)), rows, 64)
    measured = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    measured = measured.withColumn("score", score("a", "l", "r"))
    weakest = measured.groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.select("lang", F.col("gram").alias("phrase"), "a", "w.l", "w.r", "w.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    totals = grams.where("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collocations() of all documents; its docstring says what nulls, long texts, repeats and empty tables give."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
u AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM u, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
o AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN o USING (lang, phrase) WHERE NOT coalesce(c.k = 2 AND 100 * o.f >= 50 * c.f, false)),
x AS (SELECT lang, phrase, f, unnest(range(1, k)) AS cut, w FROM d),
s AS (SELECT x.lang, x.phrase, x.f AS a, cut, a1.f AS l, a2.f AS r, ((1000000::HUGEINT * x.f * x.f) // (a1.f::HUGEINT * a2.f))::BIGINT AS score FROM x JOIN g a1 ON a1.lang = x.lang AND a1.phrase = array_to_string(x.w[1:cut], ' ') JOIN g a2 ON a2.lang = x.lang AND a2.phrase = array_to_string(x.w[cut + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM s) WHERE i = 1),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) JOIN t USING (lang) WHERE rank <= 2000"""
