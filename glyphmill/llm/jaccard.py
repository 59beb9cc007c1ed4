"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts are lower-cased (A-Z) and cut into words; a document is the set of its
distinct k-word shingles (with fewer words, the whole sequence).  Documents
link when the Jaccard similarity of their sets is at least ``percent`` / 100.

1. One pass hashes the sets.  Documents with the same words are one text from
   here on.  A count sketch of fixed size over all shingles of all documents
   gives the global order: rarer first, ties by hash.
2. With t = ceil(similarity * size) of a document's shingles needed for any
   link, its l-prefix is the first size - t + l shingles, and any two linked
   documents share at least min(l, l') shingles of their prefixes.  Each document
   takes the l of least estimated cost: the sketch's counts of its prefix are
   the rows to probe, their sum over l bounds the candidates to verify.
3. Shingles that occur in one prefix only are dropped.  First each document is
   compared with a few of the smallest documents of its shingles' lists; links
   found so contract the lists.  In up to ``ROUNDS`` rounds the documents outside
   a list's main component are compared with a few members of it.  Then every pair
   of a list whose documents lie in different components and fit in size is made
   once, if the prefixes have at least min(l, l') shingles in common, and so many
   that those after the prefixes can still make up the overlap that a link needs.
   Such pairs are verified on their whole sets.  Pairs in one component need no
   comparison: the components are exact, and the first comparisons are in
   proportion to the lists.
4. No pair is verified whose sets differ too much by a lower bound: the parities
   of the sets' shingles in ``PARITIES`` cells differ in no more cells than the
   sets have shingles of their own.

Null texts count as empty: they have no shingles, link with nothing and are
their own component.  Rows with a null key have component null.  Texts are
known by a 64-bit hash of their words and linked on their own; rows with the
same key share a component, their n_shingles are their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import as_bytes, drop_scratch, read, release, scratch
from ._text import binary_rows, shingle_set
from ._tree import SCHEMA, piece_rows, pieces, sum_arrays
from .components import components

#: Cells of the sketch; its size (4 bytes each) bounds what is broadcast.
CELLS = 1 << 20
#: Lists of more documents than this make a pair once only, at the cost of carrying their documents' prefixes.
LONG_LIST = 128
#: Documents of a long list in one part of it: a list of any length is compared in parts of this size.
LIST_PART = 512
#: Cells of a set's parities, in words of 64.
PARITIES = 512
#: Rounds against main components before all pairs, and members a document is compared with in each.
ROUNDS, MEMBERS = 2, 2
#: Bytes of sets that a task keeps while it verifies.
HELD_SETS = 32 << 20
#: The longest multi-match, and the cost of verifying a candidate in probed rows.
LONGEST, VERIFY_COST = 8, 8.0


def _node(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(text.lower().split()), digest_size=8).digest(), "little", signed=True)


def _nodes(texts):
    return F.pandas_udf(lambda t: t.map(lambda x: _node(x or b"")).astype("int64"), "long")(texts)


def _first_pass(docs: DataFrame, k: int) -> DataFrame:
    """One row per document (key, n, node) and, from each task, the sketch in stripes (stripe, counts)."""
    kind = docs.schema["_key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        key_type = to_arrow_type(kind)
        counts = np.zeros(CELLS, np.int64)
        for batch, texts in binary_rows(batches, "_text"):
            sets = [shingle_set(t, k) for t in texts]
            counts += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(key_type), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(t) for t in texts], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["_key", "n", "node", "stripe", "counts"])
        stripes, contents = pieces([counts])
        n = len(stripes)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, key_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(stripes, pa.int32()), pa.array(contents, pa.binary())], names=["_key", "n", "node", "stripe", "counts"])

    return docs.mapInArrow(run, f"_key {kind.simpleString()}, n long, node long, stripe int, counts binary")


def needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def choose_prefix(estimates: np.ndarray, n: int, percent: int) -> int:
    """The multi-match l of least estimated cost; ``estimates``: candidates behind each shingle, in the global order."""
    t = needed(n, percent)
    most = max(1, min(LONGEST, t))
    rows = np.cumsum(estimates[: n - t + most])[n - t :]
    ell = np.arange(1, len(rows) + 1)
    return int(np.argmin(rows + VERIFY_COST * rows / ell)) + 1


def prefix(text: bytes, k: int, percent: int, sketch: np.ndarray, noise: float) -> tuple[int, np.ndarray]:
    """l and the l-prefix of a text's shingles."""
    shingles = shingle_set(text, k)
    n = len(shingles)
    if not n:
        return 1, shingles
    counts = sketch[(shingles & np.uint64(CELLS - 1)).astype(np.int64)]
    order = np.argsort(counts, kind="stable")  # ties stay in the order of hashes
    ell = choose_prefix(np.maximum(counts[order].astype(float) - noise, 0.0), n, percent)
    return ell, shingles[order[: n - needed(n, percent) + ell]]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each of PARITIES cells holds an odd number of the shingles, 64 cells a number."""
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) & (PARITIES - 1), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near(percent: int, a: str, b: str) -> str:
    """SQL: the sets of columns n_a, parities_a and n_b, parities_b can be similar enough; of those that are, all pass."""
    cells = " + ".join(f"bit_count(parities_{a}[{k}] ^ parities_{b}[{k}])" for k in range(PARITIES // 64))
    return f"({cells}) * {100 + percent} <= (n_{a} + n_{b}) * {100 - percent}"


def _prefixes(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    mean = float(sketch.mean())
    noise = mean + 4 * mean**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in binary_rows(batches, "_text"):
            found = [prefix(t, k, percent, shared.value, noise) for t in texts]
            cells = np.concatenate([parities(shingle_set(t, k)) for t in texts])
            odd = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (PARITIES // 64)), pa.array(cells))
            offsets = np.concatenate([[0], np.cumsum([len(p) for _, p in found])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([p for _, p in found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_node(t) for t in texts], pa.int64()), pa.array([e for e, _ in found], pa.int32()), tokens, odd], names=["_key", "node", "ell", "tokens", "parities"])

    kind = docs.schema["_key"].dataType.simpleString()
    return docs.mapInArrow(run, f"_key {kind}, node long, ell int, tokens array<long>, parities array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def of(node: int, text: bytes) -> np.ndarray:
            nonlocal held, size
            if node not in held:
                found = shingle_set(text, k)
                if size + found.nbytes > HELD_SETS:
                    held, size = {}, 0
                held[node] = found
                size += found.nbytes
            return held[node]

        for batch in batches:
            keep = []
            for u, v, a, b in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                x, y = of(u, a), of(v, b)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["u"].dataType.simpleString()
    left, right = texts.select(F.col("rep").alias("u"), F.col("text").alias("a")), texts.select(F.col("rep").alias("v"), F.col("text").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, f"u {kind}, v {kind}")


def _texts(pairs: DataFrame, held: DataFrame, keyed: DataFrame) -> DataFrame:
    """rep, text of all documents in the pairs.

    A bitmap of fixed size over the keys' hashes keeps most other texts out of the shuffle; the join is exact.
    """
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = scratch(nodes.join(keyed, "node").select("_key", "node"), "candidates")
    cell = F.pmod(F.xxhash64("_key"), F.lit(CELLS)).alias("cell")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            seen[batch.column(0).to_numpy()] = 1
        yield piece_rows([seen])

    bitmap = pairs.sparkSession.sparkContext.broadcast(sum_arrays(scratch(wanted.select(cell).mapInArrow(mark, SCHEMA), "bitmap"), [CELLS])[0] > 0)
    marked = F.pandas_udf(lambda c: pd.Series(bitmap.value[c.to_numpy()]), "boolean")
    near = held.where("_key IS NOT NULL").where(marked(cell)).withColumn("node", _nodes("_text"))
    exact = near.join(wanted, ["_key", "node"])  # a key may have other texts as well
    return scratch(exact.groupBy("node").agg(F.min("_text").alias("text")).select(F.col("node").alias("rep"), "text"), "candidate-texts")


def _opened(lists: DataFrame, part: DataFrame) -> DataFrame:
    """The lists (token, rep, n, ell) that several components share, with component, main, long and parts."""
    spread = lists.select("token", "rep", "n", "ell").join(part.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    spread = scratch(spread, "lists-by-component")
    drop_scratch(lists)
    release(lists.sparkSession)
    count = spread.groupBy("token", "component").agg(F.count("*").alias("c"))
    main = count.groupBy("token").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("kinds"), F.sum("c").alias("length")).where("kinds > 1")
    main = scratch(main.select("token", F.col("m.component").alias("main"), (F.col("length") > LONG_LIST).alias("long"), F.when(F.col("length") > LONG_LIST, F.ceil(F.col("length") / LIST_PART)).otherwise(1).cast("int").alias("parts")), "split-tokens")
    open_ = scratch(spread.join(main, "token"), "open-lists")
    drop_scratch(spread, main)
    release(lists.sparkSession)
    return open_


def _near_pairs(pairs: DataFrame, odd: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that the parities let pass, with their number of differing cells."""
    side = lambda x: odd.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("parities").alias(f"parities_{x}"))
    cells = " + ".join(f"bit_count(parities_u[{k}] ^ parities_v[{k}])" for k in range(PARITIES // 64))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(_near(percent, "u", "v")).select("u", "v", F.expr(cells).alias("apart"))


def _members(open_: DataFrame, odd: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (u, v) of a member of a list's main component, any one, and another component's document: the nearest for each document."""
    member = open_.where("component = main").groupBy("token").agg(F.min_by(F.struct(F.col("rep").alias("u"), F.col("n").alias("m")), F.xxhash64("rep", "token", F.lit(turn))).alias("x"))
    met = open_.where("component <> main").join(member.select("token", "x.*"), "token").where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    near = _near_pairs(met.select("u", F.col("rep").alias("v")).distinct(), odd, percent)
    order = Window.partitionBy("v").orderBy("apart", "u")
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= MEMBERS).select("u", "v")


def _open_pairs(open_: DataFrame, percent: int, odd: DataFrame | None = None) -> DataFrame:
    """The pairs (u, v) to verify of lists (token, rep, n, ell, component, main, long, parts) with several components.

    ``odd``: the documents' parities (rep, parities), where they are known.  A long list's documents are dealt to ``parts`` parts; those outside its main component, which all pairs need, meet every part.
    """
    # what a document has in long lists and in short ones: at most its prefix
    has = open_.groupBy("rep").agg(F.collect_list(F.when(F.col("long"), F.col("token"))).alias("tokens"), F.count_if(~F.col("long")).alias("short_n"))
    has = has.withColumn("long_n", F.size("tokens"))
    known = [] if odd is None else ["parities"]
    has = scratch(has.join(odd.select("rep", "parities"), "rep") if known else has, "open-prefixes")
    short = open_.where("NOT long").join(has.select("rep", F.col("long_n").alias("elsewhere"), *known), "rep")
    long = open_.where("long").join(has.select("rep", "tokens", F.col("short_n").alias("elsewhere"), *known), "rep")
    one, other = (f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND component_a <> component_b", "(component_b = main_b OR rep_a < rep_b)" + (f" AND {_near(percent, 'a', 'b')}" if known else ""))
    rest = f"greatest(({percent} * n_a + 99) DIV 100 - ell_a, ({percent} * n_b + 99) DIV 100 - ell_b) + least(elsewhere_a, elsewhere_b)"
    enough = f"({{c}} + least(elsewhere_a, elsewhere_b) >= least(ell_a, ell_b) AND ({{c}} + {rest}) * {100 + percent} >= {percent} * (n_a + n_b))"

    def apart(rows: DataFrame, *more: str) -> DataFrame:
        """Pairs of a list in different components: one of them is not of the list's main component."""
        columns = ("rep", "n", "ell", "component", "main", "elsewhere", *known, *more)
        every, mine = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.pmod(F.xxhash64("rep"), "parts").cast("int")
        side = lambda x, part: rows.where("component <> main" if x == "a" else "true").select(F.col("token").alias(f"token_{x}"), part.alias(f"part_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        rule = f"token_a = token_b AND part_a = part_b AND {one} AND {other}"
        if more:  # once for each pair, and only where its prefixes agree often enough
            common = "array_intersect(tokens_a, tokens_b)"
            rule += f" AND {enough.replace('{c}', f'size({common})')} AND array_min({common}) = token_a"
        tasks = 4 * open_.sparkSession.sparkContext.defaultParallelism  # few bytes make many pairs: such tasks are not to be merged
        a, b = (side(x, part).repartition(tasks, f"token_{x}", f"part_{x}") for x, part in (("a", every), ("b", mine)))
        return a.join(b, F.expr(rule)).withColumns({"u": F.least("rep_a", "rep_b"), "v": F.greatest("rep_a", "rep_b")})

    # a pair's first side differs from list to list: from here on a is u and b is v
    own = lambda c, x, y: F.min(F.when(F.col("rep_a") == F.col("u"), F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))).alias(f"{c}_{x}")
    made = apart(short).groupBy("u", "v").agg(F.count("*").alias("c"), *(own(c, *sides) for c in ("n", "ell", "elsewhere") for sides in ("ab", "ba")))
    return made.where(enough.replace("{c}", "c")).select("u", "v").unionByName(apart(long, "tokens").select("u", "v")).distinct()


def _linked(docs: DataFrame, key: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """key, n, node of every row; node, rep (its smallest key) of every text with shingles; and the texts' links (u, v)."""
    spark = docs.sparkSession
    held = docs.select(F.col(key).alias("_key"), as_bytes(text).alias("_text"))
    first = scratch(_first_pass(held, k), "first-pass")
    rows = first.where("stripe IS NULL").select("_key", "n", "node")
    sketch = np.minimum(sum_arrays(first.where("stripe IS NOT NULL").select("stripe", "counts"), [CELLS])[0], 2**32 - 1).astype(np.uint32)
    full = rows.where("_key IS NOT NULL AND n > 0")
    reps = scratch(full.groupBy("node").agg(F.min("_key").alias("rep"), F.min("n").alias("n")), "representatives")
    keyed = reps.select(F.col("rep").alias("_key"), "node", "n")
    prefixes = _prefixes(held.where("_key IS NOT NULL"), k, percent, sketch).join(keyed, ["_key", "node"])
    prefixes = scratch(prefixes.select(F.col("node").alias("rep"), "n", "ell", "tokens", "parities"), "prefixes")
    release(spark)
    entries = prefixes.select(F.explode("tokens").alias("token"), "rep")
    several = entries.groupBy("token").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").select("token", "hub")
    several = scratch(several, "shared-tokens")
    release(spark)
    lists = scratch(entries.join(several, "token"), "list-entries")
    release(spark)
    sizes = prefixes.select("rep", "n", "ell")
    lists = lists.join(sizes, "rep").join(sizes.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n")), "hub")
    lists = scratch(lists.select("token", "rep", "n", "ell", "hub", "hub_n"), "lists")
    odd = scratch(prefixes.join(lists.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "parities"), "parities")
    drop_scratch(several, prefixes)
    release(spark)

    # each document against the smallest of its lists: the one with most of its prefix in common, and others with a good part of the shorter one
    fits = "100 * least({a}, {b}) >= {p} * greatest({a}, {b})"
    stars = lists.where(f"rep <> hub AND {fits.format(a='n', b='hub_n', p=percent)}").groupBy("hub", "rep").agg(F.count("*").alias("c"), F.min(F.least("n", "hub_n")).alias("n"))
    stars = stars.withColumn("k", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("c"), "hub"))).where(f"k = 1 OR 300 * c >= {100 - percent} * n")
    stars = scratch(_near_pairs(stars.select(F.col("hub").alias("u"), F.col("rep").alias("v")), odd, percent).select("u", "v"), "stars")
    links = scratch(_verified(stars, _texts(stars, held, keyed), k, percent), "star-links")
    release(spark)
    open_ = _opened(lists, components(links))

    # documents outside a list's main component against members of it
    for turn in range(ROUNDS):
        stars = scratch(_members(open_, odd, percent, turn), "stars")
        found = scratch(_verified(stars, _texts(stars, held, keyed), k, percent), "star-links")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        open_ = _opened(open_, components(links))

    # every pair of a list across components
    pairs = scratch(_open_pairs(open_, percent, odd), "pairs")
    more = scratch(_verified(pairs, _texts(pairs, held, keyed), k, percent), "links")
    release(spark)
    return rows, reps.select("node", "rep"), links.unionByName(more)


def _named(reps: DataFrame, part: DataFrame) -> DataFrame:
    """The texts with their component."""
    return reps.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id of every row."""
    rows, reps, links = _linked(docs, key, text, k, percent)
    # a key with several texts ties them together
    full = rows.where("_key IS NOT NULL AND n > 0")
    several = full.groupBy("_key").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v <> last").select("_key", "v")
    tied = full.join(several, "_key").select(F.col("node").alias("u"), "v")
    named = _named(reps, components(links.unionByName(tied)))
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component_id")
    found = rows.join(named, "node", "left")
    mine = F.when((F.col("n") > 0) & F.col("_key").isNotNull(), F.col("component_id")).otherwise(F.col("_key"))
    return found.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), mine.alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of linked texts, that of the smallest key, with all its columns; null keys and unlike texts of one key stay.

    Texts without shingles stay once for each key.
    """
    rows, reps, links = _linked(docs, key, text, k, percent)
    first = _named(reps, components(links)).groupBy("component").agg(F.min(F.struct("rep", "node")).alias("m")).select("m.*")
    kept = first.unionByName(rows.where("_key IS NOT NULL AND n = 0").select(F.col("_key").alias("rep"), "node").distinct())
    kept = kept.select(F.col("rep").alias("_kept"), F.col("node").alias("_kept_node"))
    held = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_key"), _nodes(as_bytes(text)).alias("_node"))
    named = held.where("_key IS NOT NULL").join(kept, (F.col("_key") == F.col("_kept")) & (F.col("_node") == F.col("_kept_node"))).dropDuplicates(["_key", "_node"])
    return named.select("_doc").unionByName(docs.where(F.col(key).isNull()).select(F.struct(*docs.columns).alias("_doc"))).select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g FROM d, unnest(range(1, greatest(len(ws) - 2, 2))) u(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, m.low) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON m.a = d.doc_id
"""
