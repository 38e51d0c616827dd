"""Every query of the operators: its columns and types, its rows against SQL or brute force, on small whole tables."""

import collections
import glob
import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from chunkloom.llm import language, mixing, pii, quality, toxicity
from chunkloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
COLUMNS = {
    "op1_inner_product_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op5_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_weak_label_quality": {"doc_id": "bigint", "score": "double", "keep": "boolean"},
    "op7_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_byte_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10_page_language": {"page_id": "bigint", "lang": "string", "score": "double"},
    "op11_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op12_source_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op13_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}


@pytest.fixture(scope="module")
def duck():
    connection = pytest.importorskip("duckdb").connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def results(spark):
    """Rows of each query, run once."""
    kept = {}

    def of(name):
        if name not in kept:
            kept[name] = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
        return kept[name]

    return of


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    types = dict(QUERIES[name](spark, SF).dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    assert set(COLUMNS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_against_sql(results, duck, name):
    got = results(name)
    columns = sorted(got[0])
    wanted = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(wanted, key=repr)


def documents(duck):
    return duck.sql("SELECT doc_id, coalesce(text, '') AS text, source FROM documents").fetchall()


def test_personal_data_query(results, duck):
    from test_documents import reference_spans

    texts = {d: t for d, t, _ in documents(duck)}
    got = results("op2_personal_data")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = reference_spans(texts[r["doc_id"]])
        joined = [f"{k}:{s}:{e}" for s, e, k in base]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(kind == k for _, _, kind in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert set(joined) <= {":".join(x) for x in spans} and len({tuple(x) for x in spans}) == len(spans)
        assert [(int(s), pii.KINDS.index(k)) for k, s, _ in spans] == sorted((int(s), pii.KINDS.index(k)) for k, s, _ in spans)


def test_toxicity_query(results, duck):
    got = {r["doc_id"]: r for r in results("op3_toxicity")}
    assert sorted(got) == sorted(d for d, _, _ in documents(duck))
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_packing_query(results, duck):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from chunkloom.llm.packing import least_bins, tokenizer_file

    tokenizer, wanted, lengths = Tokenizer.from_file(tokenizer_file()), collections.Counter(), []
    for d, text, _ in documents(duck):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            lengths.append(len(own))
            wanted[d, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    got, filled = results("op5_best_fit_packing"), collections.defaultdict(list)
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in map(sorted, filled.values()):
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(own[-1]) <= 4096
    assert len(filled) <= least_bins(np.bincount(lengths, minlength=4097), 4096) + 1


def test_mixing_query(results, duck):
    got = results("op9_source_mixing")
    counted = duck.sql(r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, source FROM documents").fetchall()
    by_id = {d: (n, s) for d, n, s in counted}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for _, n, s in counted:
        sizes[s] += n
    for r in got:
        n, s = by_id[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[s] and r["taken"] % max(n, 1) == 0 and r["taken"] <= 2 * n
        taken[s] += r["taken"]
        target[s] = r["target"]
    from test_documents import reference_targets

    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    assert [target[s] for s in order] == pytest.approx(reference_targets([sizes[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))]))
    longest = {s: max(n for n, t in by_id.values() if t == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= min(longest[s], 0.02 * sizes[s]) for s in order)


def test_sharding_query(results, duck):
    got = sorted(results("op8_byte_sharding"), key=lambda r: (r["shard"], r["slot"]))
    texts = {d: t.encode() for d, t, _ in documents(duck)}
    total, at = sum(len(t) + 1 for t in texts.values()), 0
    for d, r in zip(sorted(texts), got, strict=True):
        size = len(texts[d]) + 1
        assert (r["doc_id"], r["size"], r["text_crc32"], r["shard"]) == (d, size, zlib.crc32(texts[d]), (2 * at + size) * 16 // (2 * total))
        at += size
    assert all(r["slot"] == (0 if k == 0 or got[k - 1]["shard"] != r["shard"] else got[k - 1]["slot"] + 1) for k, r in enumerate(got))


def test_quality_and_language_queries(results, duck):
    assert sorted(r["doc_id"] for r in results("op6_weak_label_quality")) == sorted(d for d, _, _ in documents(duck))
    assert all(0 <= r["score"] <= 1 and r["keep"] == (r["score"] >= 0.5) for r in results("op6_weak_label_quality"))
    assert sorted(r["page_id"] for r in results("op10_page_language")) == sorted(x for (x,) in duck.sql("SELECT page_id FROM pages").fetchall())


# --- models against brute force


def test_noisy_or_against_brute_force():
    rng = random.Random(1)
    texts = ["", "one two. three!", ". ".join("w" + str(rng.randrange(50)) for _ in range(40)), "alone"]
    bias, leak = -1.5, -4.0
    from chunkloom.llm._words import sentence_words, word_features

    table = np.random.default_rng(2).normal(size=1 << toxicity.BITS).astype(np.float32)
    table[np.random.default_rng(3).random(len(table)) < 0.97] = 0  # most features tell nothing
    got, _, firsts = toxicity._scores(pa.array(texts, pa.large_string()), (table, bias, leak))
    for text, score in zip(texts, got, strict=True):
        clean = 1 - 1 / (1 + np.exp(-leak))
        words, codes, sentence, text_of, _ = sentence_words(pa.array([text], pa.large_string()))
        for s in range(len(text_of)):
            z, tells = bias, False
            for code, own in zip(codes.tolist(), sentence.tolist(), strict=True):
                if own == s:
                    features, _ = word_features(words.slice(code, 1), toxicity.BITS)
                    z += float(table[features].astype(np.float64).sum())
                    tells |= bool((table[features] != 0).any())
            p = 1 / (1 + np.exp(-z))
            clean *= 1 - (p - toxicity.NOTHING) / (1 - toxicity.NOTHING) if tells and p > toxicity.NOTHING else 1
        assert score == pytest.approx(1 - clean, abs=1e-9)


def test_estimation_against_brute_force():
    rng = np.random.default_rng(3)
    v = rng.integers(-1, 2, (60, 3))
    counts = collections.Counter(quality._codes(v).tolist())
    share, rates = quality.estimate(counts, 3, rounds=4)
    # the same steps, one document after the other
    rows = (v + 1).tolist()
    posterior = []
    for row in rows:
        bad, good = row.count(1), row.count(2)
        posterior.append((0.05 if 2 * bad > good else 0.2) if bad else 0.9)
    for _ in range(4):
        own = np.full((2, 3, 3), 0.5)
        for row, p in zip(rows, posterior, strict=True):
            for k, x in enumerate(row):
                own[1, k, x] += p
                own[0, k, x] += 1 - p
        own /= own.sum(axis=2, keepdims=True)
        prior = sum(posterior) / len(posterior)
        posterior = []
        for row in rows:
            odds = [prior, 1 - prior]
            for k, x in enumerate(row):
                odds[0] *= own[1, k, x]
                odds[1] *= own[0, k, x]
            posterior.append(odds[0] / sum(odds))
    assert share == pytest.approx(prior) and rates == pytest.approx(own)


def test_fusion_against_brute_force(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate([("de", "der die das und ist"), ("en", "the of and is that"), ("fr", "le la les et est")] * 20)], "doc_id long, text string, lang string")
    model = language.text_model(docs)
    rng = random.Random(4)
    words = {"de": "der die das und ist", "en": "the of and is that", "fr": "le la les et est"}
    pages = []
    for k in range(60):
        lang = rng.choice(list(words))
        text = " ".join(rng.choice(words[lang].split() + ["xyz"]) for _ in range(rng.randrange(0, 4)))
        said = rng.choice(["", lang, lang, "it", "en"])
        pages.append((k, f"https://www.h{k % 7}.{rng.choice(['org', lang])}/x", f"<html lang='{said}'><p>{text}</p>" if said else text))
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    n, c = len(model.languages), language.SMOOTHING
    text = {k: model.posteriors(pa.array([html.split("<p>")[-1].replace("</p>", "")], pa.large_string()))[0] for k, _, html in pages}
    host = {k: url.split("/")[2] for k, url, _ in pages}
    suffix = {k: h.rsplit(".", 1)[1] for k, h in host.items()}
    said = {k: html.split("'")[1] if html.startswith("<html") else "" for k, _, html in pages}
    kind = {k: s if s in model.languages or not s else "*" for k, s in said.items()}

    def summed(of, key):
        return sum((text[k] for k in text if of[k] == key), np.zeros(n)), sum(of[k] == key for k in of)

    base = (sum(text.values()) + 1) / (len(text) + n)
    forms = [*model.languages, "", "*"]
    chance = np.array([summed(kind, f)[0] for f in forms]) + 0.5
    chance /= chance.sum(axis=0)
    for k in text:
        s, m = summed(suffix, suffix[k])
        near = (s + c * base) / (m + c)
        s, m = summed(host, host[k])
        odds = np.maximum(text[k], 1e-30) * chance[forms.index(kind[k])] * (s + c * near) / (m + c)
        assert got[k]["lang"] == model.languages[int(odds.argmax())] and got[k]["score"] == pytest.approx(odds.max() / odds.sum())
