import hashlib
import os
import random
import re
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents, rows_of  # noqa: E402

from drawpool.llm import fuzzy_lines as fl  # noqa: E402
from drawpool.llm.textgrid import ALNUM, Grid  # noqa: E402

_ALONE = "฀-໿က-Ⴟក-៿　-鿿\U00020000-\U00033fff"


def _words(line):
    line = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
    return re.findall(f"[{_ALONE}]|[^{_ALONE} ]+", line)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _most(a, b):
    return max(len(a), len(b)) * (100 - fl.PERCENT) // 100


def _sims(forms):
    """The tables of each form (a list of words)."""
    raw = [" ".join(w).encode() for w in forms]
    grid = fl.characters(Grid(np.frombuffer(b"\n".join(raw), np.uint8), np.array([0, len(b"\n".join(raw))]), ALNUM, True))
    x = fl.Lines(grid)
    assert len(x.first) == len(forms)
    bag = fl.distinct(x.words, x.first, x.end)
    assert [b - a for a, b in zip(*bag[1:])] == [len(set(w)) for w in forms]
    return np.stack([fl.simhash(*bag, t) for t in range(fl.TABLES)], axis=1).view(np.uint64)


def _meet(p, q):
    """Whether two classes share a block of a table and are near in it."""
    for x, y in zip(p, q):
        d = int(x) ^ int(y)
        if d.bit_count() <= fl.DISTANCE and any(not d >> (fl.BLOCK * i) & ((1 << fl.BLOCK) - 1) for i in range(fl.BLOCKS)):
            return True
    return False


def _brute(docs, meet=True):
    """Rows by all pairs of lines; without ``meet`` by edit similarity alone."""
    key = lambda d: (d is None, d or 0)
    at, comp = {}, {}
    for d, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            w = tuple(_words(line))
            if w:
                at.setdefault(w, []).append((key(d), n))
                comp[w] = w

    def root(w):
        while comp[w] != w:
            w = comp[w]
        return w
    forms = sorted(w for w in comp if len(w) >= fl.LEAST)
    sims = _sims(forms) if forms else []
    for i, a in enumerate(forms):
        for j in range(i):
            b = forms[j]
            if abs(len(a) - len(b)) <= _most(a, b) and (not meet or _meet(sims[i], sims[j])) and _distance(a, b) <= _most(a, b):
                comp[root(a)] = root(b)
    first = {}
    for w, places in at.items():
        first[root(w)] = min([first.get(root(w), ((True, 10**9), 0)), *places])
    out = []
    for d, t in docs:
        lines = (t or "").split("\n") if t else []
        kept = [x for n, x in enumerate(lines) if not _words(x) or first[root(tuple(_words(x)))] == (key(d), n)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


def _got(out):
    return sorted(str(tuple(r)) for r in out.collect())


def _edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        i = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[i] = f"e{rng.randrange(10**6)}"
        elif kind == 1 and len(w) > 1:
            del w[i]
        else:
            w.insert(i, f"e{rng.randrange(10**6)}")
    return w


def _lines(rng):
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 8, 20, 30, 60, 90]))] for _ in range(25)]
    for _ in range(250):
        w = _edited(rng, rng.choice(base), rng.randrange(0, 3))
        yield rng.choice([" ", "  ", ", "]).join(w if rng.random() < 0.8 else [x.upper() for x in w])


def test_against_brute_force(spark):
    rng = random.Random(8)
    lines = list(_lines(rng))
    docs = [(rng.randrange(10**6), "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for _ in range(90)]
    docs += [(4, None), (5, ""), (6, "\n\n"), (None, docs[0][1] + "\nan own line of null"), (7, docs[2][1]), (7, docs[2][1]), (7, docs[3][1]), (8, "one two three"), (9, "one two three")]
    assert _got(fl.fuzzy_lines(documents(spark, docs))) == _brute(docs)


def test_nine_of_ten_links_by_edit_similarity_are_found():
    """Lines at the least similarity of all, by length; words as skewed as those of texts."""
    rng = random.Random(1)
    weight = [1 / (i + 1) for i in range(5000)]
    for low, high in ((20, 30), (30, 50), (50, 80), (80, 200)):
        pairs = []
        while len(pairs) < 400:
            a = [f"w{i}" for i in rng.choices(range(5000), weight, k=rng.randrange(low, high))]
            b = _edited(rng, a, len(a) * (100 - fl.PERCENT) // 100)
            if len(b) >= fl.LEAST and a != b and _distance(a, b) <= _most(a, b):
                pairs.append((a, b))
        p, q = (_sims([x[i] for x in pairs]) for i in (0, 1))
        found = sum(map(_meet, p, q)) / len(pairs)
        assert found >= 0.9, (low, high, found)


def test_families_by_edit_similarity_alone(spark):
    rng = random.Random(5)
    docs = []
    for i in range(60):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 90, 150]))]
        docs += [(10 * i + j, " ".join(_edited(rng, w, j > 0))) for j in range(4)]
    assert _got(fl.fuzzy_lines(documents(spark, docs))) == _brute(docs, meet=False)


def test_large_family_of_variants(spark):
    rng = random.Random(9)
    base = [f"word{i}" for i in range(120)]
    docs = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(120)] = f"v{i}"
        docs.append((i, " ".join(w)))
    out = fl.fuzzy_lines(documents(spark, docs)).collect()
    assert [r["n_removed"] for r in sorted(out)] == [0] + [1] * 399


def test_very_long_lines(spark):
    rng = random.Random(6)
    w = [f"w{rng.randrange(9000)}" for _ in range(30_000)]
    docs = [(1, " ".join(w)), (2, " ".join(_edited(rng, w, 40)) + "\nshort"), (3, " ".join(reversed(w))), (4, "x" * 200_000)]
    got = {r["doc_id"]: r["n_removed"] for r in fl.fuzzy_lines(documents(spark, docs)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


def test_repartition_changes_nothing(spark):
    rng = random.Random(10)
    docs = documents(spark, [(i, "\n".join(_lines(rng))) for i in range(3)])
    assert rows_of(fl.fuzzy_lines(docs)) == rows_of(fl.fuzzy_lines(docs.repartition(5)))


def test_empty_table(spark):
    assert fl.fuzzy_lines(documents(spark, [])).count() == 0


def test_short_lines_and_scripts_without_spaces(spark):
    rng = random.Random(3)
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    thai = "".join(chr(0x0E01 + rng.randrange(46)) for _ in range(40))
    docs = [(1, "Home\nRead more\n---\n\n" + chinese), (2, "home\nread more!\n---\n\n" + chinese), (3, chinese[:7] + "あ" + chinese[8:] + "\n" + thai),
            (4, thai + "\nRead less"), (5, "one two three"), (6, "one two three\nHome"), (7, "go " + chinese[:9]), (8, "go" + chinese[:9] + "\U00020001 ok")]
    out = fl.fuzzy_lines(documents(spark, docs))
    assert _got(out) == _brute(docs)
    got = {r["doc_id"]: r["n_removed"] for r in out.collect()}
    assert [got[d] for d in range(1, 9)] == [0, 3, 1, 1, 0, 2, 0, 0]


def test_characters_are_words_in_scripts_without_spaces():
    for text in ("ab漢字cd กขx", "été 漢", "\U00020001\U00020002z漢", "한국 かな", "漢"):
        raw = np.frombuffer(text.encode(), np.uint8)
        grid = fl.characters(Grid(raw, np.array([0, len(raw)]), ALNUM, True))
        assert [bytes(raw[a:b]).decode() for a, b in zip(grid.starts, grid.ends)] == _words(text)


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 9))] for _ in range(2))
        d = _distance(a, b)
        assert fl.bag_distance(np.array(a, int), np.array(b, int)) <= d
        for most in (0, 2, 9):
            assert fl.edit_distance(np.array(a), np.array(b), most) == min(d, most + 1)


def test_simhash_is_the_majority_of_the_words_bits():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**63, 100_000).astype(np.uint64)
    cut = np.array([0, 1, 3, 258, 513, 30_000, 99_000, 100_000])
    for table in (0, 4):
        got = fl.simhash(words, cut[:-1], cut[1:], table)
        for a, b, g in zip(cut[:-1], cut[1:], got):
            bits = np.unpackbits(fl.mix(words[a:b] ^ fl.mix(np.full(1, table + 1, np.uint64))).view(np.uint8).reshape(-1, 8), axis=1)
            assert np.packbits(2 * bits.sum(0, dtype=int) > b - a).view(np.int64)[0] == g


def test_simhashes_of_all_tables_at_once():
    """Short lines, lines about a run of counters, and one of many runs."""
    rng = np.random.default_rng(7)
    size = np.concatenate([rng.integers(1, 130, 300), [251, 252, 253, 504, 505, 3000], rng.integers(1, 9, 50)])
    end = np.cumsum(size)
    words = rng.integers(0, 2**63, int(end[-1])).astype(np.uint64)
    got = fl.simhashes(words, end - size, end, range(fl.TABLES))
    for table in range(fl.TABLES):
        seed = fl.mix(np.full(1, table + 1, np.uint64))
        for a, b, g in zip(end - size, end, got[table]):
            bits = np.unpackbits(fl.mix(words[a:b] ^ seed).view(np.uint8).reshape(-1, 8), axis=1)
            assert np.packbits(2 * bits.sum(0, dtype=int) > b - a).view(np.int64)[0] == g


def test_members_of_a_bucket_come_in_any_order():
    """Tasks sort by bucket alone; the first partner of a member is still the smallest."""
    rng = np.random.default_rng(11)
    n = np.arange(1, 60)
    bucket = np.repeat(np.arange(len(n)), n)
    ids = rng.permutation(len(bucket))
    sim = (bucket % 7 << 30) + (1 << rng.integers(0, 20, len(bucket)))
    rows = pa.RecordBatch.from_pydict({"bucket": bucket, "id": ids, "sim": sim})
    want = {(b, i): min(j for j in ids[bucket == b]) for b, i in zip(bucket.tolist(), ids.tolist()) if 2 <= n[b] < 59 and b}
    for step in (5000, 40):
        out = pa.Table.from_batches(fl._partners(rows.slice(lo, step) for lo in range(0, len(bucket), step)))
        got = {(b, i): t for b, i, t in zip(out["bucket"].to_pylist(), out["id"].to_pylist(), out["to"].to_pylist())}
        assert {k: v for k, v in got.items() if k in want} == want


def test_texts_are_read_only_where_a_class_is_wanted():
    texts = ["a b c\nd e", "f g\n\nh", "a b c"]
    grid = Grid(np.frombuffer("f g".encode(), np.uint8), np.array([0, 3]), ALNUM, True)
    marks = np.zeros((1 << 24) // 8 + 4096, np.uint8)
    rows = marks.copy()
    for bits, key in ((marks, fl._hashes(fl.Lines(grid).node)["h"][0]), (rows, np.int64(6))):
        slot = int(key) & (1 << 24) - 1
        bits[(1 + (slot - 1) // 32768) * 4096 + (slot - 1) % 32768 // 8] |= 1 << (slot - 1) % 8
    batch = pa.RecordBatch.from_pydict({"text": texts, "rk": [5, 6, 7]})
    assert [b["words"].to_pylist() for b in fl._line_texts(rows, marks)([batch])] == [["f g"]]
    assert list(fl._line_texts(np.zeros_like(rows), marks)([batch])) == []


def test_members_without_a_partner_do_not_go_on():
    """Buckets inside a partition are compared; those at its borders and large ones go on whole."""
    rng = np.random.default_rng(4)
    bucket, sim = [], []
    for b, n in enumerate((3, 1, 50, fl.PART + 5, 2, 1, 4, 2)):
        s = rng.integers(0, 2**63, n)
        if n in (50, 4):
            s[n - 1] = s[0] ^ 0b1011
        bucket += [b] * n
        sim += s.tolist()
    rows = pa.RecordBatch.from_pydict({"bucket": bucket, "id": list(range(len(bucket))), "sim": sim})
    near = lambda i, j: (sim[i] ^ sim[j]).bit_count() <= fl.DISTANCE
    size = np.bincount(bucket)
    want = [i for i, b in enumerate(bucket) if b in (0, 7) or size[b] > fl.PART or any(bucket[j] == b and near(i, j) for j in range(max(0, i - 60), min(i + 60, len(bucket))) if j != i)]
    for step in (1000, 7, 5000):
        out = pa.Table.from_batches(fl._partners(rows.slice(lo, step) for lo in range(0, len(bucket), step)))
        assert out["id"].to_pylist() == want
        assert [(a, b) for a, b in zip(out["to"].to_pylist(), want) if a != b and size[bucket[b]] in (50, 4)] == [(bucket.index(x), len(bucket) - 1 - bucket[::-1].index(x)) for x in (2, 6)]
    assert list(fl._partners(iter([]))) == []


def test_one_first_pair_for_each_member(spark, monkeypatch):
    """A family of n variants costs n pairs before the linking rounds, not one for each block of each."""
    rng, seen = random.Random(9), []
    base = [f"word{i}" for i in range(120)]
    docs = [(i, " ".join(base[:k] + [f"v{i}"] + base[k + 1:])) for i, k in enumerate(rng.choices(range(120), k=300))]
    link = fl.link
    monkeypatch.setattr(fl, "link", lambda *a, pairs: seen.append(pairs.count()) or link(*a, pairs=pairs))
    assert sum(r["n_removed"] for r in fl.fuzzy_lines(documents(spark, docs)).collect()) == 299
    assert 0 < seen[0] < 300


MASK = (1 << 64) - 1


def test_no_link_fails_the_bound():
    """Lines at the limit of edits differ in no more parities than two an edit."""
    rng = random.Random(12)
    for _ in range(300):
        a = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(20, 120))]
        b = _edited(rng, a, len(a) * (100 - fl.PERCENT) // 100)
        most = _most(a, b)
        x = fl.Lines(Grid(np.frombuffer(raw := " ".join(a).encode() + b"\n" + " ".join(b).encode(), np.uint8), np.array([0, len(raw)]), ALNUM, True))
        for c in fl.parities(x.words, x.first, x.end):
            assert (int(c[0]) & MASK ^ int(c[1]) & MASK).bit_count() <= 2 * max(most, _distance(a, b))
        go, _ = fl.partners(np.zeros(2, np.int64), np.zeros(2, np.int64), fl.parities(x.words, x.first, x.end)[0], x.end - x.first)
        assert go.all() or _distance(a, b) > most


def test_a_family_without_links_names_few_pairs(spark, monkeypatch):
    """n variants that differ by two edits from each other share blocks, but are not n * n / 2 pairs to verify."""
    rng, seen = random.Random(13), []
    base = [f"word{i}" for i in range(39)]
    docs = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(39)], w[rng.randrange(39)] = f"v{i}", f"u{i}"
        docs.append((i, " ".join(w)))
    verify = fl._verify
    monkeypatch.setattr(fl, "_verify", lambda *a: lambda pairs: seen.append(pairs.count()) or verify(*a)(pairs))
    assert _got(fl.fuzzy_lines(documents(spark, docs))) == _brute(docs)
    assert sum(seen) < 600, seen
