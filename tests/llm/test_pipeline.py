"""The pipeline's stages against brute force, and the registered queries against their SQL."""

import math
import os
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from glyphmill.llm import packing, quality, queries, secrets

from .test_operators import ROWS, WORD, plain_components, plain_targets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rows = [(k, r[1], "en", r[2], len(r[1]) if r[1] is not None else None) for k, r in enumerate(ROWS)]
    long = [(500 + k, " ".join(f"w{(k * 7 + j * j) % 97}x{j % (11 + k)}" for j in range(60 + k)) + (" token = abcdefghijklmnop0123" if k % 3 == 0 else ""), "en", f"s{k % 3}", 0) for k in range(30)]
    docs = spark.createDataFrame(rows + long, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    before = [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = [tuple(r) for r in out.collect()]
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality rules":
            assert Counter(after) == Counter(r for r in before if quality.first_rejection(quality.Features((r[1] or "").encode()), quality.RULES) is None)
        elif name == "n-gram Jaccard join":
            comps = plain_components([(r[0], r[1]) for r in before], 5, 80)
            smallest = {d for d, _, c in comps if d == c}
            assert Counter(after) == Counter(r for r in before if r[0] in smallest)
        elif name == "secret scans":
            want = []
            for r in before:
                spans = sorted((m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.pattern, r[1]) if len(m[rule.group]) >= rule.least)
                text, merged = r[1], []
                for a, b in spans:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                for a, b in reversed(merged):
                    text = text[:a] + "[SECRET]" + text[b:]
                want.append((r[0], text, r[2], r[3], len(text)))
            assert Counter(after) == Counter(want) and any("[SECRET]" in r[1] for r in after)
        elif name == "mixing sources to target weights":
            size = {r: len(WORD.findall(r[1])) for r in before}
            sizes = Counter()
            for r in before:
                sizes[r[3]] += size[r]
            target, taken = plain_targets(sizes), Counter()
            copies = Counter(after)
            assert set(copies) <= set(before)
            for r in before:
                share = target[r[3]] / sizes[r[3]]
                assert math.floor(share) <= copies[r] <= math.ceil(share)
                taken[r[3]] += copies[r] * size[r]
            for s in sizes:
                assert abs(taken[s] - target[s]) <= max(n for r, n in size.items() if r[3] == s)
        else:
            enc, want = packing.encoder(None), Counter()
            for r in before:
                ids = [*enc.tokenizer.encode(r[1], add_special_tokens=False).ids, 1]
                for p, at in enumerate(range(0, len(ids), 4096)):
                    part = ids[at : at + 4096]
                    want[r[0], p, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
            assert Counter(x[:5] for x in after) == want
            places = {}
            for x in after:
                places.setdefault(x[5], []).append((x[6], x[3]))
            for p in places.values():
                at = 0
                for offset, length in sorted(p):
                    assert offset == at
                    at += length
                assert at <= 4096
        docs, before = out, after


def told(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = sorted(tuple(str(told(r[c])) for c in sorted(df.columns)) for r in df.collect())
    assert got
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(queries.ORACLE_SQL[name])
        at = [want.columns.index(c) for c in sorted(df.columns)]
        assert got == sorted(tuple(str(told(r[k])) for k in at) for r in want.fetchall())
