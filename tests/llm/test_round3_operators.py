"""PartEnum join, conversation trie, Merkle manifest: against brute force and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatio.llm import common, merkle, packing, partenum, prefix_trie
from curatio.llm.queries import QUERIES
from curatio.session import local_path, scratch_path


def _query(spark, name, table, rows, schema):
    """A registered query over a folder that holds only this table."""
    root = scratch_path(spark, "sf")
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/{table}.parquet")
    assert local_path(root)
    return QUERIES[name](spark, root)


# --- helpers --------------------------------------------------------------------------------

def test_a_hot_key_is_joined_by_the_broadcast_and_others_by_the_shuffle(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(60)] + [(f"k{i % 7}", i) for i in range(14)] + [("none", 1)], "k string, v long")
    facts = spark.createDataFrame([("hot", 60, "H")] + [(f"k{i}", 2, f"F{i}") for i in range(7)], "k string, w long, f string")
    for how, n in (("inner", 74), ("left", 75)):
        got = common.join_hot_safe(rows, facts, ["k"], "w", 75, parts=10, how=how, floor=1)
        plain = rows.join(facts, "k", how).select("k", "v", "w", "f")
        assert got.count() == n and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("floor", [1, 20_000])
def test_components_of_chains_hubs_and_nothing(spark, floor):
    rnd = random.Random(3)
    links = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(50)] + [(200, 201 + i) for i in range(40)] + [(400 + i, 401 + i) for i in range(20)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long"), floor=floor).collect()}
    assert all(got.get(x, x) == find(x) for x in up)
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- 11: PartEnum ---------------------------------------------------------------------------

def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _classes(texts, percent):
    """doc_id -> (set size, smallest reachable id), all pairs compared."""
    sets = {d: _shingles(t) for d, t in texts.items()}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def _texts():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    out, passage = [], [rnd.choice(words) for _ in range(60)]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 5, 6, 8, 9, 14, 30, 60, 200]))]
        if rnd.random() < 0.3:
            base += passage
        out.append(" ".join(base))
        for _ in range(rnd.randrange(6)):       # copies with ever more edits
            for _ in range(rnd.randrange(3)):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            out.append(rnd.choice(["  ", "\n", "\t"]).join(base).upper() if rnd.random() < 0.3 else " ".join(base))
    out += ["", " \n", None, "one", "ONE", "one two", "É é É é É", "é é é é é", "a b c d e", "a b c d e f", "x " * 3000, "x " * 2999, "  wide   wide"]
    rnd.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("percent,block", [(80, 1024), (80, 2), (60, 3), (92, 1024)])
def test_partenum_equals_all_pairs(spark, percent, block):
    texts = _texts()
    docs = spark.createDataFrame([(t, d, 1, 2) for d, t in texts.items()], "text string, doc_id long, n long, rep long").repartition(3)
    rows = partenum.linked_classes(docs, percent=percent, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == _classes(texts, percent) and len(rows) == len(texts)


def test_similar_sets_share_a_signature_and_bits_never_exceed_the_difference():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        percent, n = int(rnd.choice([60, 80, 90])), int(rnd.integers(1, 400))
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rnd.integers(0, len(a) * (100 - percent) // 100 + 1))
        room = max(0, (100 * (len(a) - drop) - percent * len(a)) // percent)
        b = np.unique(np.concatenate([a[rnd.permutation(len(a))[drop:]], rnd.integers(0, 1 << 63, int(rnd.integers(0, room + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        different = len(a) + len(b) - 2 * both
        assert 100 * both >= percent * (len(a) + len(b) - both)
        if different:
            assert np.intersect1d(partenum.signatures(a, percent), partenum.signatures(b, percent)).size
        bits = partenum._folded([partenum.parity(a), partenum.parity(b)])
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= different


def test_partenum_edge_cases(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (3, None), (4, ""), (5, "a b c d e f"), (6, "q w e r t y u")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in _query(spark, "op11_shingle_join", "documents", rows, "doc_id long, text string").collect()), key=str)
    assert got == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (3, 0, 3), (4, 0, 4), (5, 2, 1), (6, 3, 6)], key=str)
    assert _query(spark, "op11_shingle_join", "documents", [], "doc_id long, text string").collect() == []


# --- 12: prefix trie -------------------------------------------------------------------------

def test_double_array_holds_what_was_put_in():
    rnd = random.Random(2)
    trie, want = prefix_trie.DoubleArray(4), {}
    states = [0]
    for _ in range(400):
        s = states.pop(rnd.randrange(len(states)))
        ids = np.array(sorted(rnd.sample(range(300), rnd.choice([1, 1, 1, 2, 5, 60]))))
        slots = trie.add_children(s, ids)
        want[s] = dict(zip(ids.tolist(), slots.tolist(), strict=True))
        states += slots.tolist()
    for s, kids in want.items():
        assert trie.step(np.full(len(kids), s), np.array(list(kids))).tolist() == list(kids.values())
        missing = next(i for i in range(300) if i not in kids)
        with pytest.raises((KeyError, IndexError)):
            trie.step(np.array([s]), np.array([missing]))
    assert len({x for kids in want.values() for x in kids.values()}) == sum(map(len, want.values()))


def _trie(rows):
    """Every node by brute force over the rebuilt conversations."""
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    built = {}
    for c, s in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(seqs.get(c - c % 100, [])[:h] + s[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
                       hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())) for p, m in members.items())


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_CONV = "conv_id long, turn long, role string, text string, h long, seq string"


def test_trie_equals_brute_force(spark):
    rnd = random.Random(8)
    rows = [(None, 0, "user", "lost")]
    for c in [*range(0, 60), *range(200, 330), *range(505, 520)]:
        shared = rnd.choice(["hi", "hello é", "", "go"])
        n = rnd.choice([1, 2, 3, 5, 7])
        rows += [(c, None if i == 0 and c % 9 == 0 else i, rnd.choice(["user", None]) if i else "user", shared if i == 0 else rnd.choice([None, "a", "bb", "x" * 30])) for i in range(n)]
    rows += [(300, 2, "user", "again")] * 2 + [(7, 50 + i, "user", f"t{i}") for i in range(300)]
    rows += [(1000 + i, t, "user", f"copy{t}") for i in range(50) for t in range(3)]        # many equal conversations
    got = _query(spark, "op12_prefix_trie", "conversations", [(*r, 1, "x") for r in rows], _CONV).select(*_NODE).collect()
    assert sorted(str(tuple(r)) for r in got) == _trie(rows)


def test_trie_without_turns_and_without_rows(spark):
    c = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 6 > 1)     # conversation 0 is absent: nothing is left
    got = _query(spark, "op12_prefix_trie", "conversations", [(c, 0, "user", "x", 1, "y")], _CONV).select(*_NODE).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert _query(spark, "op12_prefix_trie", "conversations", [], _CONV).collect() == []


def test_ids_of_a_large_group_are_hashed_in_order_across_texts(spark):
    ids = spark.range(0, 10_000).select(F.lit("k").alias("key"), "id").unionByName(spark.createDataFrame([("a", 5), ("z", 3)], "key string, id long"))
    texts = ids.repartitionByRange(5, "key", "id").sortWithinPartitions("key", "id").mapInArrow(prefix_trie._id_texts, "key string, first long, ids string")
    assert texts.where("key = 'k'").count() >= 3
    got = texts.repartition(3, "key").sortWithinPartitions("key", "first").mapInArrow(prefix_trie._id_digests, "key string, ends string").collect()
    want = {"k": ",".join(map(str, range(10_000))), "a": "5", "z": "3"}
    assert {r.key: r.ends for r in got} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


# --- 13: Merkle manifest ---------------------------------------------------------------------

def _hex(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(leaves, fanout):
    """(top, per leaf the (left, right) siblings of each level)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = at[i] // fanout * fanout
            nodes, k = level[run:run + fanout], at[i] - run
            path.append(("".join(nodes[:k]), "".join(nodes[k + 1:])))
            at[i] //= fanout
        level = [_hex("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


@pytest.mark.parametrize("fanout", [2, 3])
def test_proofs_equal_brute_force(spark, fanout):
    sizes = {None: 1, "": 2, "de": 33, "en": 1100, "fr": 32, "é": 65}
    rows = [(g, i, _hex(f"{g}-{i}")) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, digest string").repartition(5)
    leaves = df.select(merkle.tree_key(F.col("g")).alias("tree"), "id", "digest", F.struct("g", "id").alias("load"))
    got = {(r.g, r.id): r for r in merkle.proofs(leaves, fanout).select(
        "load.*", "digest", "path", "facts.*", merkle.fold(F.col("digest"), F.col("path")).alias("folded"), merkle.proof_digest(F.col("path")).alias("proof")).collect()}
    tops = {g: _tree([_hex(f"{g}-{i}") for i in range(n)], fanout) for g, n in sizes.items()}
    root, upper = _tree([tops[g][0] for g in sizes], fanout)
    assert len(got) == len(rows)
    for k, (g, n) in enumerate(sizes.items()):
        for i in range(n):
            r, path = got[g, i], tops[g][1][i] + upper[k]
            assert [tuple(s) for s in r.path] == path and (r.root, r.subroot, r.folded) == (root, tops[g][0], root)
            assert r.proof == _hex("".join(a + b for a, b in path))


def test_nodes_cover_their_interval(spark):
    table = common.written(spark.range(70).select(F.lit("=x").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit("l").alias("load")), "leaves")
    rows = merkle.nodes(merkle.climb(merkle.ranked(table, ["id"]), 2)).collect()
    by_level = defaultdict(list)
    for r in rows:
        by_level[r.level].append((r.lo, r.hi, r.digest))
    assert [len(by_level[i]) for i in range(8)] == [70, 35, 18, 9, 5, 3, 2, 1] and len(by_level) == 8
    for level, nodes in by_level.items():
        nodes.sort()
        assert nodes[0][0] == 0 and nodes[-1][1] == 70 and all(a[1] == b[0] for a, b in zip(nodes, nodes[1:], strict=False))
        if level:
            below = sorted(by_level[level - 1])
            assert all(d == _hex("".join(x[2] for x in below if lo <= x[0] and x[1] <= hi)) for lo, hi, d in nodes)


def test_manifest_edge_cases(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, lo long"
    rows = [(1, "s", "en", 3, "abc", "x", 9), (1, "s", "en", 3, "abc", "x", 9), (None, None, None, None, None, None, None), (2, None, "en", None, "", "", 0),
            (5, "é", "de", 2, "éé" * 5000, "x", 1)] + [(i, "s", "fr", i, f"t{i}", "x", 1) for i in range(10, 30)]
    got = _query(spark, "op13_merkle_manifest", "documents", rows, schema).collect()
    assert len(got) == len(rows) and len({r.root for r in got}) == 1

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = sorted(_hex("".join(field(r[i]) for i in (0, 1, 2, 3, 4))) for r in rows)
    assert sorted(r.leaf for r in got) == want
    for r in got:
        bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.doc_id != 2
        assert r.verified is (not bad) and (r.folded_root == r.root) is r.verified
    assert any(not r.verified for r in got)
    only = _query(spark, "op13_merkle_manifest", "documents", rows[:1], schema).collect()[0]
    assert only.leaf == only.subroot == only.root and only.proof_sha256 == _hex("")
    assert _query(spark, "op13_merkle_manifest", "documents", [], schema).collect() == []


# --- 10: padding -----------------------------------------------------------------------------

def _fill(pieces, limits):
    """Share of the padded tokens that are tokens, after checking the limits of every sequence."""
    by = defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append(r)
    tokens = padded = 0
    for seq in by.values():
        n = sum(r.length for r in seq)
        assert n <= limits.max_tokens and len(seq) <= limits.max_segments and sum(r.loss_tokens for r in seq) <= limits.max_loss
        assert sorted(r.offset for r in seq) == list(np.cumsum([0] + [r.length for r in sorted(seq, key=lambda r: r.offset)])[:-1])
        tokens, padded = tokens + n, padded + (n if n & (n - 1) == 0 else limits.max_tokens)
    return tokens / padded


def test_short_documents_leave_little_padding(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a few words"), (F.col("id") % 97).cast("string")).alias("text")).coalesce(1)
    got = packing.pack_documents(docs).select("sequence_id", "length", "loss_tokens", "offset").collect()
    assert _fill(got, packing.Limits()) > 0.99


def test_the_loss_limit_binds_on_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").groupBy("conv_id").agg(
        F.array_join(F.collect_list(F.when(F.col("role") == "user", F.col("text"))), " ").alias("prompt"),
        F.array_join(F.collect_list(F.when(F.col("role") != "user", F.col("text"))), " ").alias("answer"))
    docs = turns.select(F.col("conv_id").alias("doc_id"), F.col("answer").alias("text"), F.substring("prompt", 1, 200).alias("prompt")).coalesce(1)
    got = packing.pack_documents(docs, limits=packing.INSTRUCTION, prompt_col="prompt").collect()
    assert _fill(got, packing.INSTRUCTION) > 0.9
    losses = defaultdict(int)
    for r in got:
        losses[r.sequence_id] += r.loss_tokens
    assert max(losses.values()) > 0.9 * packing.INSTRUCTION.max_loss


def test_limits_below_one_are_refused():
    for name in ("max_tokens", "max_segments", "max_loss", "min_cut"):
        with pytest.raises(ValueError, match=name):
            packing.Limits(**{name: 0})


def test_own_elements_are_counted_in_blocks(spark):
    rnd = np.random.default_rng(4)
    sets = {int(k): np.unique(rnd.integers(0, 3000, 400)).astype(np.uint64) << np.uint64(3) for k in rnd.integers(-2**62, 2**62, 12)}
    sets[5 << 32 | 9] = np.arange(100_000, 100_900, dtype=np.uint64)      # more than one byte counts, and the tag of the next
    sets[6 << 32 | 9] = np.arange(100_500, 101_200, dtype=np.uint64)
    rows = [(k, bytearray(partenum._packed(s, partenum.ELEMENT_BYTES))) for k, s in sets.items()]
    df = spark.createDataFrame(rows * 3, "k1 long, counted binary").repartition(5)
    got = {r.tag: r.u for r in partenum.own_elements(df, 3).collect()}
    tags = {}
    for k, s in sets.items():
        for e in s.tolist():
            tags.setdefault(e, set()).add(k & 0xFFFFFFFF)
    want = {}
    for t in tags.values():
        if len(t) == 1:
            want[min(t)] = want.get(min(t), 0) + 1
    assert got == want and want[9] == 1200
    assert partenum.own_elements(df.limit(0), 3).collect() == []


@pytest.mark.parametrize("often,most", [(64, 4096), (3, 4096), (64, 5), (2, 3)])
def test_signatures_of_several_sets_are_found_in_blocks(spark, often, most):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = {-7 + 1000 * i: np.unique(np.concatenate([base[:60 - i % 9], rnd.integers(0, 1 << 63, i % 4, dtype=np.uint64)])) for i in range(30)}
    rows = [(k, s.view(np.int64).tolist()) for k, s in sets.items()]
    df = spark.createDataFrame(rows + rows[:9], "rep long, elements array<long>").repartition(3)
    found = partenum.shared_signatures(df, min(sets), max(sets), 3, 80, block=200, often=often, most=most).cache()
    have, want = {}, {}
    for r in found.collect():
        assert len(r.reps) <= most and not (r.whole and r.bucket in have)
        have.setdefault(r.bucket, set()).update(r.reps)
    for k, s in sets.items():
        for x in np.unique(partenum.signatures(s)).tolist():
            want.setdefault(x, set()).add(k)
    want = {frozenset(m) for m in want.values() if len(m) > 1}
    assert {frozenset(m) for m in have.values()} == want and (often > 3 or found.where("NOT whole").count())
    members = {}
    for r in partenum.bucket_members(found).collect():
        members.setdefault((r.bucket, r.pivot), []).append(r.rep)
    assert sorted(map(sorted, members.values())) == sorted(map(sorted, want)) and all(p == min(m) for (_, p), m in members.items())
    assert partenum.shared_signatures(df.limit(0), 0, 0, 3, 80).collect() == []


def test_sets_of_many_buckets_of_one_pivot_travel_once(spark):
    of = {b: [0, *(x for x in range(1, 12) if (b + x) % 4)] for b in range(100, 140)} | {200: list(range(20, 50))}
    members = spark.createDataFrame([(b, r, min(m)) for b, m in of.items() for r in m], "bucket long, rep long, pivot long")
    sets = spark.createDataFrame([(r, 10) for r in range(50)], "rep long, n long")
    roots = spark.createDataFrame([(1, 0), (2, 0)], "node long, root long")
    got = partenum.mixed_units(members, roots, sets, block=16).collect()
    united = [r for r in got if r.unit == 0]
    assert len(united) == 12 and {(r.rep, b) for r in united for b in r.buckets} == {(x, b) for b, m in of.items() if b < 200 for x in m}
    assert {r.root for r in united if r.rep < 3} == {0} and {(r.chunk, r.lo, r.hi) for r in united} == {(0, 0, 0)}
    large = [r for r in got if r.unit == 200]
    assert {(r.chunk, r.lo, r.hi) for r in large} == {(-1, 0, 0), (-1, 0, 1), (-1, 1, 1)} and len(large) == 60 and len(got) == 72
    split = [r for r in partenum.mixed_units(members, roots, sets, block=16, united=3).collect() if r.unit == 0]
    assert len({r.chunk for r in split}) > 1 and sum(len(r.buckets) for r in split) == sum(len(r.buckets) for r in united)
