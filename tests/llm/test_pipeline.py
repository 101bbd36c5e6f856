"""The pipeline's stages against brute force, and its run against their composition."""

from __future__ import annotations

import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from pairlens.llm import pipeline, toxicity
from pairlens.llm.common import remainder
from pairlens.llm.queries import BPE, SURROGATE_KEY
from tests.llm.test_operators import brute_classes, brute_overlap, brute_surrogates, prose

OWN = ["raw", "_toxicity", "node", "_contamination", "_pii_found", "_near_hash", "ids", "component"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, draw = str(tmp_path_factory.mktemp("tables")), random.Random(5)
    bench = [(k, prose(500 + k, 30)) for k in range(6)] + [(6, None), (7, "lantern violin"), (None, prose(600, 25))]
    rows, labels = [], []
    for k in range(400):
        words, toxic = prose(2000 + k, 50).split(" "), k % 5 == 0
        for _ in range(4 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["vilestone", "grubling", "mudwit"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    clean = [t for k, t in rows if k % 5]
    rows += [(1000 + k, clean[k]) for k in range(20)] + [(1100 + k, clean[k] + " one more word") for k in range(20, 40)]  # copies, exact and near
    rows += [(1200 + k, prose(3000 + k, 20) + " " + bench[k % 6][1] + " " + prose(4000 + k, 20)) for k in range(12)]
    rows += [(1300 + k, prose(5000 + k, 30) + f" Mrs Anna Smith, ann{k}@mail.org, +1 (743) 555-38{k:02d}; Anna left. ") for k in range(12)]
    rows += [(None, None), (None, ""), (1400, None), (1401, " "), (1402, "one"), (None, clean[50]), (None, prose(9000, 60)), (None, prose(9000, 60)), (7, rows[7][1])]
    more = ", ".join(f"`{c}` string" for c in OWN)
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x"] * len(OWN)) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars int, {more}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, x) for k, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, tables):
    """What each stage gets and returns."""
    out, docs = [], spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in pipeline.STAGES:
        kept = stage(spark, docs, tables).cache()
        out.append((name, docs, kept))
        docs = kept
    return out


def test_columns_stay(stages):
    assert [name for name, *_ in stages] == ["toxicity", "MinHash near-dedup", "benchmark decontamination", "PII surrogates", "byte-level BPE"]
    for _, docs, kept in stages[:-1]:
        assert kept.dtypes == docs.dtypes


def test_toxic_documents_go(spark, tables, stages):
    _, docs, kept = stages[0]
    before, after = Counter(rows_of(docs)), Counter(rows_of(kept))
    assert not after - before
    gone = before - after
    toxic = {(i, t) for i, t in before if t and any(w in t for w in ("vilestone", "grubling", "mudwit"))}
    assert sum(x in toxic for x in gone) >= 0.97 * len(toxic) and sum(x not in toxic for x in gone) <= 0.01 * sum(before.values())
    model = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"), remainder(docs.doc_id, 3) != 1)
    scored = docs.select("doc_id", "text", toxicity.assess(docs, model)["score"].alias("score")).collect()
    assert after == Counter((r.doc_id, r.text) for r in scored if r.score < pipeline.TOXIC)


def test_one_of_each_group_stays(stages):
    _, docs, kept = stages[1]
    before, after = rows_of(docs), Counter(rows_of(kept))
    named = [(k, t) for k, (_, t) in enumerate(before)]  # every row by its place
    groups = {i: c for i, n, c in brute_classes(named, 5, 80) if n}
    members = {}
    for k, c in groups.items():
        members.setdefault(c, []).append(before[k])
    want = Counter(x for k, x in enumerate(before) if k not in groups)  # wordless rows stay, one of equal ones
    want = Counter({x: 1 for x in want})
    for rows in members.values():
        ids = [i for i, _ in rows if i is not None]
        mine = [x for x in rows if after[x]]
        assert len(mine) >= 1 and sum(after[x] for x in set(mine)) == 1 and (not ids or mine[0][0] == min(ids))
        want[mine[0]] += 1
    assert after == want


def test_benchmark_passages_go(spark, tables, stages):
    _, docs, kept = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    assert Counter(rows_of(kept)) == Counter(x for x in rows_of(docs) if not brute_overlap(x[1], items, 10)[1])
    assert not any(i is not None and 1200 <= i < 1300 for i, _ in rows_of(kept))


def test_personal_data_is_replaced(stages):
    _, docs, kept = stages[3]
    before = rows_of(docs)
    want = Counter((i, t) for (i, _), (t, _) in zip(before, brute_surrogates([t for _, t in before], SURROGATE_KEY)))
    assert Counter(rows_of(kept)) == want and not any("Anna" in (t or "") or "@mail.org" in (t or "") for _, t in want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())


def test_ids_decode(spark, tables, stages):
    with open(BPE[0], "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, docs, kept = stages[4]
    pack = lambda t: b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(t or ""))
    want = Counter((i, len(pack(t)) // 4, pack(t), True) for i, t in rows_of(docs))
    assert kept.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.round_trip) for r in kept.collect()) == want
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.round_trip) for r in pipeline.run(spark, tables).collect()) == want


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
