"""Small tables with NULLs, empty and long texts, ties, repeated rows, clashing columns; empty tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatio.llm import (ann, bilstm_crf, boosting, common, fingerprints, langid, line_dedup, mixing, order_minhash,
                         packing, pii, token_files, toxicity)
from curatio.llm.chunks import ChunkTable, ragged, token_table
from curatio.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate double, bucket string, n long"


def words(seed, n, alphabet="abcdefghij"):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list(alphabet), 5)) for _ in range(n))


LONG = words(1, 9000)
TEXTS = [None, "", "   \n ", "one", "A b, c'd\nété 12", LONG, LONG, words(2, 60), "\x1cab <|endoftext|> 你好", "x́  y"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 0.5, "b", 2) for i, t in enumerate(TEXTS)]
    rows += [rows[7], (None, "null id", "en", "s", 1, 0.5, "b", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(common.tokenizer_file())


def ids_of(tok, text, end):
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


def test_chunk_table_forgets_without_changing_results():
    table = ChunkTable(lambda ws: ragged([[len(w), ord(w[0])] for w in ws], np.int64), np.int64, limit=20)
    for k in range(30):
        texts = [" ".join(f"w{i % 97}" for i in range(k, k + 50)), None, " \n"]
        flat, n = table.rows(texts)
        assert flat.tolist() == [x for w in texts[0].split() for x in (len(w), ord(w[0]))] and n.tolist() == [100, 0, 0]


def test_tokens_equal_the_tokenizers(tok):
    texts = [*TEXTS, "it's I'LL don''s", "ÀÉ ß x×y", "ẞ İ ﬁ ²", "a\u0085b c"]
    flat, n = token_table(common.tokenizer_file()).rows(texts)
    assert flat.tolist() == [i for t in texts for i in ids_of(tok, t, 0)[:-1]]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_number_coding_round_trip(n):
    v = (np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64) >> np.arange(n, dtype=np.uint64) % np.uint64(31)).astype(np.uint32)
    control, data = token_files.encode_numbers(v)
    assert (token_files.decode_numbers(control, data, n) == v).all() and len(control) == -(-n // 4)


def test_token_files(spark, docs, none, tok):
    path = scratch_path(spark, "t")
    token_files.write_token_files(docs, path)
    got = sorted(token_files.read_sequences(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x)
    at, by_id = 0, dict(enumerate(TEXTS)) | {None: "null id"}
    for r in got:
        want = ids_of(tok, by_id[r.doc_id], 1)
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(want), want)
        at += len(want)
    assert len(got) == 12
    path = scratch_path(spark, "t")
    token_files.write_token_files(none, path)
    assert token_files.read_sequences(spark, path).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(max_tokens=64, max_loss=64, max_segments=4, min_cut=4, group=5),
                                    packing.Limits(max_tokens=64, max_loss=40, max_segments=8, min_cut=4)])
def test_packing(docs, none, tok, limits):
    got = packing.pack_documents(docs, limits=limits, prompt_col="source").collect()
    seqs, by_doc = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for rs in seqs.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0, *[r.length for r in rs[:-1]]]).tolist()
        assert sum(r.length for r in rs) <= 64 and len(rs) <= limits.max_segments and sum(r.loss_tokens for r in rs) <= limits.max_loss
    for doc, text in {**dict(enumerate(TEXTS)), None: "null id"}.items():
        want = [*tok.encode("s", add_special_tokens=False).ids, *ids_of(tok, text, 2)]
        assert sum(r.length for r in by_doc[doc]) == len(want) * (2 if doc == 7 else 1)
        assert all(np.frombuffer(r.ids, "<u4").tolist() == want[r.start:r.start + r.length] and r.doc_tokens == len(want) for r in by_doc[doc])
    assert packing.pack_documents(none).count() == 0


def test_language(spark, docs, none):
    rows = [(i, words(i, 30, "aeioumn" if i % 2 else "xkzqwrt"), "l1" if i % 2 else "l2") for i in range(200)]
    table = spark.createDataFrame([*rows, (900, None, "l1"), (901, "abc", None)], "doc_id long, text string, lang string")
    model = langid.train(table.where("doc_id % 5 > 0 AND doc_id < 900"))
    got = {r.doc_id: r for r in langid.predict(table, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i % 5 == 0)
    assert (got[900].lang_pred, got[900].score) == ("und", 0.0) and 0 <= got[901].score <= 1
    out = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert [out[i] for i in range(3)] == ["und"] * 3 and langid.predict(none, langid.train(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(none)).collect()} == {"und"}


def test_fingerprints_against_sets(docs, none):
    a, b = fingerprints.digests(LONG), fingerprints.digests(fingerprints.edited(LONG, words(3, 9000)))
    for x, y in ((a, b), (a, a), (a[:0], b), (a[:0], a[:0])):
        only_x, only_y = fingerprints.differences([x], [y], 6)
        assert set(only_x[0]) == set(x) - set(y) and set(only_y[0]) == set(y) - set(x)
    assert len(set(fingerprints.digests("a\n" * 9))) == 9
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs).collect()}
    order = sorted([*enumerate(TEXTS), (-1, "null id"), (7, TEXTS[7])], reverse=True, key=lambda x: (x[0], x[1] or ""))
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        t, nxt = t or "", nxt or ""
        r = got[i if i >= 0 else None]
        if i == 7:      # two equal rows: one follows the other
            continue
        assert r.edited_sha256 == hashlib.sha256((t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]).encode()).hexdigest(), i
        assert r.n_chars == len(t)
    assert got[5].fingerprint == got[6].fingerprint and got[6].near_next == 1.0
    assert fingerprints.compare_with_next(none).count() == 0


def test_nearest_vectors(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(400, 9))
    v[50:150] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(500, None), (501, [0.0] * 9), (502, [float("nan")] * 9), (503, [None] * 9), (504, [1.0]), (None, [1.0] * 9), rows[20]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in ann.search(table, F.col("vec_id") % 20 == 0, share=1.0, k=7).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        score = np.array([x @ v[q] for x in v])
        best = sorted((-s, i) for i, s in enumerate(np.round(score, 12)) if i != q)[:7]
        assert [i for _, i, _ in sorted(found)] == [i for _, i in best] and np.allclose([s for *_, s in sorted(found)], [-s for s, _ in best])
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.search(few, F.lit(True)).count() == 6 and ann.search(table.limit(0), F.lit(True)).count() == 0


def test_personal_data(spark, docs, none):
    text = "mail a.b@c.de, 1.2.3.4 or 999.2.3.4; 4111 1111 1111 1111 x +1 (262) 555-7240 and a@b.c@d.ef +12"
    kinds = [(k, text[s:e]) for k, s, e in pii.base_spans(text)]
    assert kinds == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (262) 555-7240"), ("email", "a@b.c")]
    assert pii.base_spans("1" * 50_000) == [] and pii.base_spans("a" * 50_000 + "@") == []
    rows = [(i, f"{words(i, 12)} +1 ({200 + i}) 555-{1000 + i} {words(i + 500, 9)} u{i}@mail{i % 9}.example.com {words(i, 5)} 10.{i % 250}.3.7 "
                f"{words(i, 8)} {i}{i}77 {words(i, 9)}") for i in range(250)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    net = pii.train(table, max_windows=500)
    held = [t for t, _, some in (x for i in range(300, 330) for x in pii.training_windows(rows[i - 100][1].replace("555", "444"))) if some]
    assert held
    test = [f"{words(9, 12)} ({300 + i}) 444-{5000 + i} {words(8, 12)}" for i in range(20)]
    found = pii.added_spans(net, test, [pii.base_spans(t) for t in test])
    assert sum(any(k == "phone" for k, *_ in f) for f in found) >= 15         # a form that the patterns do not know
    got = {r.doc_id: r.spans for r in pii.find(docs, net).collect()}
    assert got[0] == [] and got[1] == [] and pii.train(none) is None and pii.find(none, None).count() == 0


def test_personal_data_without_ascii_digits(spark):
    """Addresses with a word for the sign and numbers of other scripts are read, with no digit or @ nearby."""
    rows = [(i, f"{words(i, 12)} {words(i + 900, 1)}.{words(i + 950, 1)}@{words(i + 990, 1)}.example.com {words(i + 500, 9)} "
                f"+1 ({200 + i}) 555-{1000 + i} {words(i, 8)} at {words(i + 3, 4)}. At {words(i + 7, 9)}") for i in range(250)]
    net = pii.train(spark.createDataFrame(rows, "doc_id long, text string"), max_windows=500)
    for sign in (" (at) ", "[at]", " @ "):
        test = [f"{words(9, 12)} {words(i + 1900, 1)}.{words(i + 1950, 1)}{sign}{words(i + 1990, 1)}.example.com {words(8, 12)}" for i in range(20)]
        assert not any(pii.base_spans(t) for t in test)
        found = pii.added_spans(net, test, [[] for _ in test])
        assert sum(any(k == "email" and sign.strip() in t[s:e] for k, s, e in f) for f, t in zip(found, test, strict=True)) >= 15, sign
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    test = [f"{words(9, 12)} ({300 + i}) 444-{5000 + i} {words(8, 12)}".translate(arabic) for i in range(20)]
    assert sum(any(k == "phone" for k, *_ in f) for f in pii.added_spans(net, test, [[] for _ in test])) >= 15


def test_every_accepted_span_opens_a_window():
    for kind, s in (("email", "a.b (at) c.de"), ("email", "a.b[AT]c.de"), ("email", "a_at_c.de"), ("email", "aATc.de"), ("email", "a{At}c.de"),
                    ("email", "a @ c.de"), ("ip", "١.٢.٣.٤"), ("phone", "（٢٦٢".replace("（", "(") + ") ٥٥٥-٧٢٤٠"), ("card", "４１１１.１１１１.１１１１.１１１１")):
        assert pii._plausible(kind, s) and pii.windows_of(s), s
    assert not pii._plausible("email", "data.example.com") and pii.windows_of("that data. " * 50) == []


def test_network_gradient():
    net = bilstm_crf.Net(5, 3, embed=3, hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(0)
    x, y, lengths = r.integers(0, 5, (3, 7)), r.integers(0, 3, (3, 7)), np.array([7, 4, 1])
    _, grad = net.loss_and_gradient(x, y, lengths)
    for k, w in net.w.items():
        at = tuple(r.integers(0, s) for s in w.shape)
        old, out = w[at], []
        for step in (1e-3, -1e-3):
            w[at] = old + step
            out.append(net.loss_and_gradient(x, y, lengths)[0])
        w[at] = old
        assert abs((out[0] - out[1]) / 2e-3 - grad[k][at]) < 1e-5, k


def test_toxicity(spark, docs, none):
    bad = ["vile", "filth", "scab", "dreg"]
    rows = [(i, words(i, 40) + (f" you {bad[i % 4]} {bad[i % 3]}!" if i % 3 == 0 else " you fine.")) for i in range(900)]
    table = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(700)] + [(1000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    assert set(bad) <= set(model.lexicon)
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert all((got[i] > 0.5) == (i % 3 == 0) for i in range(700, 900)) and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(none, labels.limit(0))).collect()} == {0.0}


def test_isotonic_and_trees():
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    margin = boosting.fit(x[:1500], y[:1500]).margin(x[1500:])
    assert ((margin > 0) == y[1500:]).mean() > 0.95
    knots, values = boosting.isotonic(margin, y[1500:])
    assert (np.diff(values) >= 0).all() and values.min() >= 0 and values.max() <= 1


def chunked(text):
    """Chunks by the definition, in plain Python."""
    lines, out, part, before = text.split("\n"), [], [], 0
    for i, line in enumerate(lines):
        h = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
        part.append(line)
        if (before * 31 + h) % line_dedup.DIVISOR == 0 or i == len(lines) - 1:
            out.append("\n".join(part))
            part = []
        before = h
    return out


def test_line_dedup(spark, docs, none):
    shared = "\n".join(words(100 + i, 6) for i in range(12))
    rows = [(i, "\n".join([words(i, 5), words(i + 50, 4), shared, words(i + 90, 3)])) for i in range(6)]
    rows += [(6, f"{shared}\n{shared}"), (7, None), (8, ""), (9, rows[0][1]), (9, rows[0][1])]
    got = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = set()
    for i, t in dict(rows).items():
        if t is None:
            assert got[i].text is None
            continue
        kept = []
        for c in chunked(t):
            if "\n" in c and c in seen:
                continue
            seen.add(c)
            kept.append(c)
        assert got[i].text == "\n".join(kept), i
        assert got[i].lines_removed == len(t.split("\n")) - sum(len(c.split("\n")) for c in kept)
    assert got[9].text != rows[0][1]
    out = line_dedup.remove_repeated_chunks(docs)
    assert out.columns == [*docs.columns, "lines_removed"] and out.count() == 12
    assert line_dedup.remove_repeated_chunks(none).count() == 0


def test_mixing_meets_targets(spark, docs, none):
    kinds = {"a": "abcd", "b": "efgh", "c": "ijkl"}
    rows = [(i, words(i, 20 + i % 50, kinds["abc"[min(i % 5, 2)]])) for i in range(600)]
    table = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "abc"[min(i % 5, 2)]) for i in range(0, 600, 3)], "doc_id long, d string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    mixed = mixing.mix(table, labels, F.col("d"), weights).toPandas()
    p, tokens = mixed[["p0", "p1", "p2"]].to_numpy(), mixed["tokens"].to_numpy()
    total = (mixed["rate"].to_numpy() * tokens) @ p
    assert np.allclose(p.sum(axis=1), 1) and (mixed["rate"] >= 0).all()
    assert np.allclose(total / total.sum(), [0.5, 0.3, 0.2], atol=1e-6) and len(mixed) == 602
    assert total.sum() <= tokens.sum() * (1 + 1e-9)
    again = mixing.apply_mix(table.withColumn("_copies", F.lit(1)), mixing.mix(table, labels, F.col("d"), weights))
    assert again.columns == ["doc_id", "text", "_copies"] and again.count() == mixed["copies"].sum()
    assert mixing.mix(docs, labels, F.col("d"), weights).count() == 12 and mixing.mix(none, labels, F.col("d"), weights).count() == 0


def test_mixing_keeps_clean_documents_of_a_clean_table(spark):
    """Hardly any toxic text: no clean document goes for want of it, and what there is too much of is still thinned."""
    weights = {"clean": 0.86, "low": 0.10, "toxic": 0.04}
    for every, n_low in ((10, 60), (3, 200)):
        kind = ["toxic" if i < 3 else "low" if i % every == 0 else "clean" for i in range(600)]
        rows = [(i, words(i, 40 + i % 20, {"clean": "abcd", "low": "efgh", "toxic": "ijkl"}[k])) for i, k in enumerate(kind)]
        labels = spark.createDataFrame([(i, k) for i, k in enumerate(kind) if i % 2 or i < 3], "doc_id long, d string")
        mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.col("d"), weights).toPandas()
        tokens = mixed["tokens"].to_numpy()
        total = (mixed["rate"].to_numpy() * tokens) @ mixed[["p0", "p1", "p2"]].to_numpy()
        mass = tokens @ mixed[["p0", "p1", "p2"]].to_numpy()
        assert mass[2] < 0.03 * mass.sum() and np.allclose(total, np.minimum(np.array([0.86, 0.10, 0.04]) * mass[0] / 0.86, mass), rtol=1e-4)
        copies, rate = dict(zip(mixed["id"], mixed["copies"], strict=True)), dict(zip(mixed["id"], mixed["rate"], strict=True))
        clean = [i for i, k in enumerate(kind) if k == "clean"]
        assert sum(copies[i] >= 1 for i in clean) >= 0.99 * len(clean) and min(rate[i] for i in clean) > 0.95, every
        assert every == 10 or sum(copies[i] for i, k in enumerate(kind) if k == "low") < 0.5 * n_low


def all_pairs(rows):
    table = order_minhash._word_table()
    s = {i: order_minhash.labelled_shingles(table.rows([t])[0]) for i, t in rows}
    root = {i: i for i in s}
    pairs = [(i, j) for i in s for j in s if i < j and len(s[i]) and len(s[j]) and order_minhash.similarity(s[i], s[j]) >= 0.8]
    for _ in rows:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("block", [4, 1024])
def test_open_buckets_in_blocks(spark, block):
    """Texts that share a passage share buckets without being similar; near copies among them are found."""
    passage, rows = words(900, 70), []
    for f in range(25):
        own = words(f, 24).split()
        rows.append((len(rows), passage + " " + " ".join(own)))
        if f % 3 == 0:
            rows.append((len(rows), passage + " " + " ".join([*own[:-1], f"other{f}"])))
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    root = all_pairs(rows)
    assert {x.doc_id: x.class_id for x in got.collect()} == root and len(set(root.values())) == 25


def test_near_duplicates_against_all_pairs(spark, docs, none):
    r, rows = np.random.default_rng(5), []
    for f in range(12):
        base = words(f, int(r.integers(8, 300))).split()
        for k in range(6):
            w = list(base)
            for _ in range(k):
                w[int(r.integers(len(w)))] = f"new{r.integers(1 << 30)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(100, rows[3][1].upper() + "!"), (101, None), (102, ""), (103, "$$"), (104, rows[3][1])]
    got = {x.doc_id: x.class_id for x in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = all_pairs(rows)
    assert got == root and got[100] == got[104] == got[3] and [got[i] for i in (101, 102, 103)] == [101, 102, 103]
    classes = order_minhash.near_duplicates(docs)
    kept = sorted((x.doc_id for x in order_minhash.keep_one(docs, classes).collect()), key=str)
    assert kept == ["0", "1", "2", "3", "4", "5", "7", "8", "9", "None"] or kept == [0, 1, 2, 3, 4, 5, 7, 8, 9, None]
    assert order_minhash.near_duplicates(none).count() == 0


def test_components(spark):
    r = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    root = {x: x for p in links for x in p}
    for _ in range(60):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(root[k] == got.get(k, k) for k in root)


def test_hot_safe_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("id").alias("m")).where("k % 2 = 0")
    got = common.join_hot_safe(rows, facts, ["k"], "w", 1000, parts=100)
    assert sorted(got.collect()) == sorted(rows.join(facts, "k").select("k", "id", "w", "m").collect())


def test_held_out_rule(spark):
    got = {r.doc_id: r.h for r in spark.range(50).select(F.col("id").alias("doc_id")).withColumn("h", common.held_out()).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.items())
