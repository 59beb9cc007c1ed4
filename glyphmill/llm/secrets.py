"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed (sha-256 of its text).  The
ledger holds the (blob, rule version) pairs that were scanned and their spans.
A scan reads one copy of each blob that has unseen pairs, runs just the unseen
rules on it, and joins the findings back to all paths and versions that hold
the blob.  A rule's version is a hash of its definition, so that a changed rule
is a new pair.  The ledger is a table that scans append to (``write_ledger``).

Spans are code point offsets, end exclusive.  Matches are leftmost and
non-overlapping within a kind: ``split`` gives the text between matches and
``regexp_extract_all`` the matches, each a row of its own, whose running lengths
give the offsets: the work is linear in the number of matches.  Texts with many
copies meet their findings in salted groups.
Null texts count as empty.  Repeated rows (same path and text) each get the
blob's findings; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import read, scratch


@dataclass(frozen=True)
class Rule:
    """``pattern``: a Java regular expression; ``group``'s code points must number ``least``.  ``gate`` matches wherever ``pattern`` can."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    gate: str | None = None

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]}"


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + f"|{_any_case('api')}_?{_any_case('key')}"
BASE_RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
_PEM = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
#: A key runs to its END line; where that is missing, over its headers and lines of base64 (a last short one too).
_TO_END = "[^-]*(?:-{1,4}[^-]+){0,20}-----END [A-Z ]{0,40}PRIVATE KEY-----"
_HEADERS = r"(?:[\x20\t\r\n]*[A-Za-z-]+:[^\n]*\n){0,9}"
_BASE64 = r"(?:[A-Za-z0-9+/=\x20\t\r\n\\]*[A-Za-z0-9+/=]{16,}(?:[\x20\t]*[\r\n]+[A-Za-z0-9+/=]+)?)?"
RULES = (
    *BASE_RULES,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", _PEM + f"(?:{_TO_END}|{_HEADERS}{_BASE64})", gate=_PEM),
)
SPAN = "struct<kind:string,rank:int,start:bigint,end:bigint>"
#: A text with more than one in so many of all rows is salted (so that there are at most so many such texts), into so many groups.
HOT_SHARE, LEAST_HOT, SALTS = 1024, 64, 256
FEW_CUTS = 32


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(rule: Rule, rank: int, text: str = "_text") -> Column:
    """struct<rank, found>: what is before each match, its length, and whether it counts."""
    p = _quoted(rule.pattern)
    zipped = f"arrays_zip(split({text}, {p}), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {rule.group}))"
    each = f"transform(filter({zipped}, x -> x.`1` IS NOT NULL), x -> named_struct('gap', length(x.`0`), 'len', length(x.`1`), 'counts', length(x.`2`) >= {rule.least}))"
    none = "CAST(array() AS array<struct<gap:int,len:int,counts:boolean>>)"
    return F.expr(f"named_struct('rank', {rank}, 'found', CASE WHEN array_contains(_todo, '{rule.version}') AND {text} RLIKE {_quoted(rule.gate or rule.pattern)} THEN {each} ELSE {none} END)")


def _spans(picked: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans of the texts (blob, _text, _todo) that have any."""
    lists = picked.select("blob", F.explode(F.array(*(_found(r, k) for k, r in enumerate(rules)))).alias("r")).where(F.size("r.found") > 0)
    each = lists.select("blob", "r.rank", F.posexplode("r.found").alias("no", "m")).select("blob", "rank", "no", "m.*")
    each = each.dropDuplicates(["blob", "rank", "no"])  # the same path may hold the same text in several rows
    before = Window.partitionBy("blob", "rank").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("len")).over(before), F.lit(0)) + F.col("gap")
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("rank") + 1)
    placed = each.withColumn("start", start).where("counts")
    span = F.struct(kind.alias("kind"), "rank", "start", (F.col("start") + F.col("len")).alias("end")).cast(SPAN)
    return placed.select("blob", span.alias("s")).groupBy("blob").agg(F.collect_list("s").alias("spans"))


def content_address(versions: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their text as ``_text`` (null as empty) and its address as ``blob``."""
    return versions.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("blob", F.sha2(F.col("_text").cast("binary"), 256))


def scan_unseen(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger's new rows: ``blob``, ``rule_versions`` scanned now, ``spans`` they found.

    ``ledger``: such rows of earlier scans.  One copy of each blob is scanned.
    """
    held = content_address(versions, text).select(F.col(path).alias("_path"), "blob", "_text")
    due = held.groupBy("blob").agg(F.min("_path").alias("_path"))
    every = F.array(*(F.lit(r.version) for r in rules))
    if ledger is None:
        due = due.withColumn("_todo", every)
    else:
        seen = ledger.select("blob", F.explode("rule_versions").alias("_seen")).distinct().where(F.col("_seen").isin([r.version for r in rules]))
        seen = seen.groupBy("blob").agg(F.collect_set("_seen").alias("_seen"))  # at most one for each rule
        due = due.join(seen, "blob", "left").withColumn("_todo", F.array_except(every, F.coalesce("_seen", F.array().cast("array<string>")))).drop("_seen")
        due = due.where(F.size("_todo") > 0)
    due = scratch(due.select(F.col("_path").alias("_rep"), F.col("blob").alias("_blob"), "_todo"), "unseen")
    picked = held.join(due, F.col("_path").eqNullSafe(F.col("_rep")) & (F.col("blob") == F.col("_blob")))
    found = _spans(picked.select("blob", "_text", "_todo"), rules)
    scanned = due.select(F.col("_blob").alias("blob"), F.col("_todo").alias("rule_versions"))
    return scanned.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob`` and its ``spans`` under the given rules, sorted by start, then kind as listed; only blobs with spans."""
    rank = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))))
    spans = ledger.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"))
    spans = spans.where(F.col("s.kind").isin([r.kind for r in rules])).select("blob", F.struct(F.col("s.start").alias("start"), rank[F.col("s.kind")].alias("rank"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind")).alias("s"))
    return spans.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def _runs(ledger: DataFrame) -> DataFrame:
    """blob, ``spans``: its runs (from, to) of overlapping or touching spans, in order."""
    each = ledger.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end")
    earlier = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    marked = each.withColumn("opens", F.coalesce(F.col("start") > F.max("end").over(earlier), F.lit(True)).cast("int"))
    upto = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    runs = marked.withColumn("run", F.sum("opens").over(upto)).groupBy("blob", "run").agg(F.min("start").alias("from"), F.max("end").alias("to"))
    return runs.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))


FOUND = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _joined_back(rows: DataFrame, blob: str, found: DataFrame, spread: Column, addresses: DataFrame) -> DataFrame:
    """``rows`` with the ``_spans`` (``spans`` of ``found``) of their blob, or null; ``addresses``: the ``blob`` of each row.

    Blobs of very many rows, a bounded number of them, are told to every task; their rows are salted by ``spread``.
    """
    counts = addresses.groupBy(F.col("blob").alias("_hot")).agg(F.count("*").alias("_n"))
    counts = scratch(counts.where(F.col("_n") >= LEAST_HOT), "copies")
    least = max(LEAST_HOT, -(-addresses.count() // HOT_SHARE))
    hot = counts.where(F.col("_n") >= least).select("_hot")  # at most HOT_SHARE rows
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(F.broadcast(hot), F.col(blob) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    each = found.join(F.broadcast(hot), F.col("blob") == F.col("_hot"), "left")
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    each = each.select(F.col("blob").alias("_of"), F.col("spans").alias("_spans"), F.explode(salts).alias("_for"))
    return dealt.join(each, (F.col(blob) == F.col("_of")) & (F.col("_salt") == F.col("_for")), "left").drop("_of", "_for", "_salt")


def scan(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every row of ``versions`` (path, blob) with the ``spans`` of its text, and the rows that the ledger gains by this scan."""
    new = scratch(scan_unseen(versions, path, text, rules, ledger), "ledger")
    whole = new
    if ledger is not None:
        # spans of rules whose definition has changed since don't count
        current = [r.version for r in rules]
        kinds = F.transform(F.filter("rule_versions", lambda v: v.isin(*current)), lambda v: F.substring_index(v, "@", 1))
        old = ledger.withColumn("spans", F.filter("spans", lambda s: F.array_contains(kinds, s["kind"])))
        whole = old.select("blob", "rule_versions", "spans").unionByName(new)
    rows = scratch(content_address(versions, text).select(F.col(path), "blob"), "addresses")
    joined = _joined_back(rows, "blob", findings(whole, rules), F.col(path), rows)
    return joined.select(path, "blob", F.coalesce("_spans", F.array().cast(FOUND)).alias("spans")), new


def secret_spans(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Every row of ``versions`` (path, blob) with the ``spans`` of its text."""
    return scan(versions, path, text, rules, ledger)[0]


def write_ledger(new: DataFrame, folder: str) -> None:
    """Append a scan's rows to a ledger kept as Parquet."""
    new.select("blob", "rule_versions", "spans").write.mode("append").parquet(folder)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in a folder; one that holds nothing yet if the folder is absent."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"blob string, rule_versions array<string>, spans array<{SPAN}>")
    return spark.read.parquet(folder)


def redact(docs: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents, each run of overlapping secret spans replaced by ``mark``; their other columns as they were.

    Texts without secrets, null included, stay as they are.
    """
    new = scratch(scan_unseen(docs, path, text, rules), "ledger")
    whole = F.coalesce(F.col(text), F.lit(""))
    held = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"), F.sha2(whole.cast("binary"), 256).alias("_blob"))
    addresses = scratch(content_address(docs, text).select("blob"), "addresses")
    # few cuts count code points from the start; many go over the text's characters once
    upto, since = "CAST(r.from - CASE WHEN i = 0 THEN 0 ELSE _spans[i - 1].to END AS int)", "CAST(CASE WHEN i = 0 THEN 1 ELSE _spans[i - 1].to + 1 END AS int)"
    last = "CAST(_spans[size(_spans) - 1].to + 1 AS int)"
    few = f"concat(array_join(transform(_spans, (r, i) -> concat(substring(_text, {since}, {upto}), {_quoted(mark)})), ''), substring(_text, {last}, length(_text)))"
    many = f"transform(array(split(_text, '')), c -> concat(array_join(transform(_spans, (r, i) -> concat(array_join(slice(c, {since}, {upto}), ''), {_quoted(mark)})), ''), array_join(slice(c, {last}, size(c)), '')))[0]"
    cut = f"CASE WHEN size(_spans) <= {FEW_CUTS} THEN {few} ELSE {many} END"
    joined = _joined_back(held, "_blob", _runs(new), F.col(f"_doc.{path}"), addresses).withColumn("_clean", F.expr(f"CASE WHEN _spans IS NULL THEN _text ELSE {cut} END"))
    return joined.select(*(F.col("_clean").alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two scans: the ledger that an earlier one of half the paths left saves the second the blobs it has seen
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = scan_unseen(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), "doc_id")
    found, _ = scan(docs, "doc_id", ledger=scratch(earlier, "earlier-ledger"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(spans, x -> x.kind = '{r.kind}')) AS bigint)").alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        "blob",
    )


def _oracle_sql() -> str:
    """The query's rows in DuckDB: its regular expressions, split and extraction work alike."""

    def spans(k: int, rule: Rule) -> str:
        p = "'" + rule.pattern.replace(r"[\"']", "[\"']").replace("'", "''") + "'"
        upto = lambda x, i: f"coalesce(list_sum(list_transform({x}[1:{i}], lambda y: length(y))), 0)"
        start = f"({upto('p', 'i')} + {upto('h', 'i - 1')})::BIGINT"
        return f"""(SELECT list_transform(list_filter(range(1, len(h) + 1), lambda i: length(g[i]) >= {rule.least}), lambda i: {{'s': {start}, 'rank': {k}, 'e': {start} + length(h[i]), 'kind': '{rule.kind}'}})
            FROM (SELECT string_split_regex(t, {p}) AS p, regexp_extract_all(t, {p}, 0) AS h, regexp_extract_all(t, {p}, {rule.group}) AS g))"""

    joined = spans(0, RULES[0])
    for k, rule in enumerate(RULES[1:], 1):
        joined = f"list_concat({joined}, {spans(k, rule)})"
    told = lambda a: f"array_to_string(list_transform({a}, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')"
    count = ", ".join(f"len(list_filter(a, lambda x: x.kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    base = told(f"list_filter(a, lambda x: x.rank < {len(BASE_RULES)})")
    return f"SELECT doc_id, {count}, sha256({base}) AS base_sha256, {told('a')} AS spans, sha256(t) AS blob FROM (SELECT doc_id, t, list_sort({joined}) AS a FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"


ORACLE_SQL = _oracle_sql()
