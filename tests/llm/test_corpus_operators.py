"""Periodic runs, MinHash near-duplicates and tokenizer alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabular_audit.llm import lsh_forest, periodic_runs as runs_module
from tabular_audit.llm.alignment import Aligner, align_tokenizers
from tabular_audit.llm.lsh_forest import VALUES, Stretch, likely, minhash_components, shingle_set, signature
from tabular_audit.llm.periodic_runs import Words, find_runs, periodic_runs, rule_rounds
from tabular_audit.llm.queries import QUERIES
from tabular_audit.llm.vocabulary import encoder, windows

from .conftest import ODD, SF

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- periodic runs

def plain_runs(words, least=6, times=4):
    """All runs as (start, length, period), by their definition."""
    names: dict = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words])
    found: dict = {}
    for q in range(1, len(ids) // times + 1):
        same = np.diff(np.concatenate([[0], (ids[:-q] == ids[q:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(same == 1), np.flatnonzero(same == -1)):
            if e + q - s >= max(least, times * q):
                found.setdefault((int(s), int(e + q)), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def runs_of(texts, least=6, times=4):
    words = Words(texts)
    start, end, period = find_runs(words.ids, words.sizes, least, times)
    out = []
    for last, size in zip(words.ends, words.sizes):
        own = (start >= last - size) & (start < last)
        out.append([(int(s - last + size), int(e - s), int(q)) for s, e, q in
                    zip(start[own], end[own], period[own])])
    return out


def repetitive_texts(n, seed):
    draw = random.Random(seed)
    for _ in range(n):
        words = []
        for _ in range(draw.randint(0, 6)):
            unit = [draw.choice("abc"[:draw.randint(1, 3)]) for _ in range(draw.randint(1, 9))]
            words += unit * draw.randint(1, 7)
        yield " ".join(words)


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (10, 3)])
def test_runs_equal_their_definition(least, times):
    texts = list(repetitive_texts(400, 1))
    for k in range(0, len(texts), 7):
        part = texts[k:k + 7]
        assert runs_of(part, least, times) == [plain_runs(t.split(), least, times) for t in part]


def test_colliding_hashes_change_nothing(monkeypatch):
    texts = [("p q r " * 40 + "x " + "p q r s " * 30 + f"y{k} " * 20) for k in range(5)]
    monkeypatch.setattr(runs_module, "STEPS", 1)
    seeds = []

    class Weak(runs_module.Stretches):
        def __init__(self, ids, seed):
            super().__init__(ids, seed)
            seeds.append(seed)

        def equal(self, i, j, size):
            return np.ones(len(i), bool) if self.seed == 1 else super().equal(i, j, size)

    monkeypatch.setattr(runs_module, "Stretches", Weak)
    assert runs_of(texts) == [plain_runs(t.split()) for t in texts]
    assert seeds == [1, 2]


def test_small_parts_of_candidates_and_texts(monkeypatch):
    monkeypatch.setattr(runs_module, "CANDIDATES", 17)
    texts = list(repetitive_texts(40, 2))
    assert runs_of(texts) == [plain_runs(t.split()) for t in texts]
    text = "ab\tcd  ef\n" * 50
    assert [w for part in runs_module.word_lists(text, 7) for w in part] == text.encode().split()


def test_the_grammar_gives_the_text_and_has_no_pair_twice():
    texts = ["to be or not to be that is to be or not " * 3, "a a a a a a a", "x y z"]
    words = Words(texts)
    rules, left = {}, []
    for turn, (start, border, end, symbol) in enumerate(rule_rounds(words.ids, words.sizes, left)):
        assert ((start < border) & (border < end)).all()
        for s, m, e, x in zip(start, border, end, symbol):
            halves = (tuple(words.ids[s:m]), tuple(words.ids[m:e]))
            assert rules.setdefault((turn, x), halves) == halves  # a symbol has one expansion
        assert min(Counter(symbol.tolist()).values()) > 1
    at, stop, text = (np.concatenate(c) for c in zip(*left))
    order = np.argsort(at)
    assert (at[order][1:] == stop[order][:-1]).all() and stop.max() == len(words.ids)
    for k in range(len(texts)):
        spans = [tuple(words.ids[a:b]) for a, b in zip(at[order], stop[order])
                 if words.ends[k] - words.sizes[k] <= a < words.ends[k]]
        pairs = Counter(zip(spans, spans[1:]))
        assert all(n == 1 or a == b for (a, b), n in pairs.items())


def test_runs_of_odd_rows(spark, odd):
    rows = periodic_runs(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    for r in rows:
        texts = {" ".join(WORD.findall(t or "")) for i, t, *_ in ODD if i == r["doc_id"]}
        assert r["collapsed"] in texts and r["runs"] == [] and r["n_words"] == len(WORD.findall(r["collapsed"]))
    assert periodic_runs(odd.limit(0)).count() == 0


def test_runs_of_long_texts(spark):
    texts = ["a " * 300_000, "b c d " * 100_000 + "e", " " * 2_000_000 + "x", "y" * 2_000_000,
             " ".join(random.Random(3).choice("ab") for _ in range(20_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(periodic_runs(docs).collect())
    assert [tuple(x) for x in rows[0]["runs"]] == [(0, 300_000, 1)] and rows[0]["collapsed"] == "a"
    assert [tuple(x) for x in rows[1]["runs"]] == [(0, 300_000, 3)] and rows[1]["collapsed"] == "b c d e"
    assert [r["n_words"] for r in rows] == [300_000, 300_001, 1, 1, 20_000]
    assert [tuple(x) for x in rows[4]["runs"]] == plain_runs(texts[4].split())


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n > 0:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_of_runs(spark, docs):
    found = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    total = 0
    for row in docs.collect():
        words, got = planted(row["doc_id"], row["text"]), found[row["doc_id"]]
        want = plain_runs(words)
        total += len(want)
        most = max(want, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        said = "".join(f"{s},{n},{q}\n" for s, n, q in want)
        assert got["n_runs"] == len(want)
        assert (got["start"], got["length"], got["period"]) == most
        assert got["exponent_milli"] == (1000 * most[1] // most[2] if want else None)
        assert got["runs_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, want).encode()).hexdigest()
    assert total > 5 and len(found) == docs.count()


# ---------------------------------------------------------------- MinHash

def plain_set(text, words=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    tokens = WORD.findall(low)
    if len(tokens) < words:
        return frozenset([tuple(tokens)] if tokens else [])
    return frozenset(tuple(tokens[k:k + words]) for k in range(len(tokens) - words + 1))


def plain_components(rows, percent=80):
    """(id, set size, least id reachable) of rows with distinct ids, by shared shingles."""
    sets, label = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}
    holders = defaultdict(list)

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, s in sorted(sets.items()):
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                label[b] = a
        for x in s:
            holders[x].append(i)
    return sorted((i, len(s), top(i)) for i, s in sets.items())


def edited(draw, words, edits):
    out = list(words)
    for at in draw.sample(range(len(out)), edits):
        out[at] = f"w{draw.randint(0, 10 ** 9)}"
    return " ".join(out)


def crowds(n, seed):
    """Near copies with few and many edits, texts sharing over half their words with a passage that
    is in all, copies, and texts near the limit."""
    draw = random.Random(seed)
    base = [f"b{k}" for k in range(120)]
    passage = [f"p{k}" for k in range(70)]
    rows = [edited(draw, base, draw.randint(0, 4)) for _ in range(n)]
    for k in range(n):
        own = [f"o{k}x{i}" for i in range(50)]
        rows.append(" ".join(passage + own))
        if k % 3 == 0:
            rows.append(edited(draw, passage + own, draw.randint(1, 4)))
    rows += [rows[draw.randrange(len(rows))] for _ in range(n // 4)]
    order = list(range(len(rows)))
    draw.shuffle(order)
    return list(zip(order, rows))


def test_components_of_crowds_equal_all_pairs(spark):
    rows = crowds(400, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r)[:3] for r in minhash_components(docs).collect())
    want = plain_components(rows)
    assert found == want
    assert 300 < len({c for _, _, c in want}) < 700


def test_components_of_documents(spark, docs):
    found = QUERIES["op12_minhash_dedup"](spark, SF)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = found.collect()
    assert sorted(tuple(r)[:3] for r in rows) == plain_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_components_of_odd_rows(spark, odd, long_text):
    rows = minhash_components(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    for r in rows:
        assert r["component_id"] == r["doc_id"] and r["kept"] == (r["doc_id"] is not None)
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {
        1: 0, 2: 0, 3: 0, 4: 1, 5: 3, 6: 4, None: 1, 7: 2, 8: 1} | {7: len(plain_set(ODD[8][1]))}
    assert minhash_components(odd.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, long_text), (2, long_text + " more"), (3, "z " * 2_000_000)],
                                 "doc_id long, text string")
    rows = sorted(minhash_components(docs).collect())
    assert [r["component_id"] for r in rows] == [1, 1, 3] and rows[2]["n_shingles"] == 1
    assert rows[0]["n_shingles"] == len(plain_set(long_text))


def test_links_through_a_row_without_id(spark):
    words = [f"c{k}" for k in range(100)]
    one, two, three = list(words), list(words), list(words)
    two[10] = two[50] = "x"
    three[10], three[50], three[30], three[80] = "x", "x", "y", "y"
    rows = [(7, " ".join(one)), (None, " ".join(two)), (3, " ".join(three)), (9, " ".join(three).upper()), (5, None)]
    assert [c for _, _, c in plain_components([(7, rows[0][1]), (3, rows[2][1])])] == [3, 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash_components(docs).collect()}
    assert found == {7: 3, None: 3, 3: 3, 9: 3, 5: 5}


def test_signatures_estimate_similarity():
    draw, errors = random.Random(5), []
    for _ in range(200):
        words = [f"s{draw.randint(0, 10 ** 6)}" for _ in range(200)]
        a, b = " ".join(words), edited(draw, words, 6)
        sets = [plain_set(a), plain_set(b)]
        real = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        mine = [shingle_set(t, 4, {}) for t in (a, b)]
        assert [len(m) for m in mine] == [len(s) for s in sets]
        errors.append((signature(mine[0]) == signature(mine[1])).mean() - real)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_pairs_of_a_stretch_grow_with_rows():
    rng = np.random.default_rng(1)
    for n in (200, 800):
        values = np.tile(rng.integers(0, 256, VALUES, dtype=np.uint8), (n, 1))
        values[rng.random((n, VALUES)) < 0.1] = 7
        values[:, :3] = 1
        values = values[np.lexsort(values.T[::-1])]
        found = Stretch(values, likely(0.8), 64, 8)
        found.search(0, n, 3)
        assert n - 1 <= len(found.pairs) <= 9 * n


def test_crowds_in_small_leaves(spark):
    """Regions a hundred times a leaf are cut deep and in parts: few links may be lost, none is made up."""
    rows = crowds(300, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = sorted(tuple(r)[:3] for r in minhash_components(docs, leaf=4).collect())
    want = plain_components(rows)
    assert sum(f != w for f, w in zip(found, want)) <= 0.02 * len(rows)
    for label in {c for *_, c in found}:
        assert len({w[2] for f, w in zip(found, want) if f[2] == label}) == 1


def test_links_span_what_is_linked():
    rng = np.random.default_rng(3)
    base = rng.choice(10 ** 6, 300, replace=False)
    sets = [np.unique(np.concatenate([base[:300 - 12 * k], 10 ** 7 + rng.choice(10 ** 6, 6 * k)])) for k in range(9)]
    sets += [np.unique(rng.choice(10 ** 6, 5000)) for _ in range(3)]
    linked = {(i, j) for i in range(12) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j]))
              >= 80 * len(np.union1d(sets[i], sets[j]))}
    for groups in (np.arange(12), np.array([0, 0, 0, 1, 2, 3, 3, 3, 3, 4, 5, 6])):
        found = lsh_forest.spanning_links(sets, groups, 80)
        between = {tuple(sorted((groups[i], groups[j]))) for i, j in linked if groups[i] != groups[j]}
        assert {tuple(sorted(p)) for p in found} <= between and found
        label = list(range(12))
        for a, b in found:
            label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
        assert all(label[a] == label[b] for a, b in between)


# ---------------------------------------------------------------- alignment

LIBRARY = Tokenizer.from_file(BYTES)
LIBRARY.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def plain_bytes():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in plain):
        names[chr(256 + k)] = b
    return names


NAMES = plain_bytes()


def plain_groups(text):
    """Groups of A and B ids by the ends of the tokens' bytes; None where bytes differ."""
    if not text:
        return None
    kinds = []
    for ids, said in ((LIBRARY.encode(" " + text, add_special_tokens=False).ids,
                       lambda i: bytes(NAMES[c] for c in LIBRARY.id_to_token(i))),
                      (MODEL.encode(text), lambda i: bytes([int(MODEL.id_to_piece(i)[3:5], 16)]) if MODEL.is_byte(i)
                       else MODEL.id_to_piece(i).replace("▁", " ").encode())):
        whole, ends = b"", {}
        for i in ids:
            whole += said(i)
            ends[len(whole)] = i
        if whole != (" " + text).encode():
            return None
        kinds.append(ends)
    groups, part = [], ([], [])
    for end in sorted(set(kinds[0]) | set(kinds[1])):
        for k in (0, 1):
            if end in kinds[k]:
                part[k].append(kinds[k][end])
        if end in kinds[0] and end in kinds[1]:
            groups.append(part)
            part = ([], [])
    return groups


def plain_measures(rows):
    groups = [(i, plain_groups(t)) for i, t in rows]
    count = Counter((a[-1], b[-1]) for _, g in groups for a, b in g or ())
    most = Counter()
    for (a, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, g in groups:
        if not g:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(a[-1], b[-1]) for a, b in g]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(pairs),
                    sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs),
                    hashlib.sha256(said.encode()).hexdigest()))
    return out, count, most


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


def test_alignment_of_documents(spark, docs):
    want, count, most = plain_measures([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert by_text(QUERIES["op13_tokenizer_alignment"](spark, SF).collect()) == by_text(want)
    _, pairs = align_tokenizers(docs, BYTES, PIECES)
    assert by_text(pairs.collect()) == by_text((a, b, n, n == most[b]) for (a, b), n in count.items())


def test_alignment_of_odd_rows(spark, odd):
    texts = [r[1] for r in ODD] + ["tail<|endoftext|>x", " two  blanks", "a\nb", "ﬁne ①", "<0x41> <s> </s>", "x" * 99,
                                  "naïve café 日本", "😀😀 👍🏽", "▁x", "nul\x00l", "The cat sat on the mat."]
    rows = list(enumerate(texts)) + [(None, "The cat sat"), (1, "again"), (1, "again")]
    clash = spark.createDataFrame([(*r, 1, "k", 2) for r in rows],
                                  "doc_id long, text string, weight int, key string, slice int")
    assert by_text(align_tokenizers(clash, BYTES, PIECES)[0].collect()) == by_text(plain_measures(rows)[0])
    assert align_tokenizers(odd, BYTES, PIECES)[0].count() == len(ODD)
    measures, pairs = align_tokenizers(odd.limit(0), BYTES, PIECES)
    assert measures.count() == 0 and pairs.count() == 0


def test_alignment_of_long_texts(spark):
    texts = ["a" * 600_000, " " * 700_000 + "x", "the cat sat " * 60_000, "\n" * 600_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(align_tokenizers(docs, BYTES, PIECES)[0].collect())
    for text, row in zip(texts, rows):
        groups = plain_groups(text) or []
        assert (row["n_groups"], row["n_a"]) == (len(groups), sum(len(a) for a, _ in groups))


def test_copies_are_aligned_once(spark, monkeypatch):
    rows = [(k, "one text of many copies") for k in range(200)] + [(900, "another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    measures, pairs = align_tokenizers(docs, BYTES, PIECES)
    want, count, _ = plain_measures(rows)
    assert by_text(measures.collect()) == by_text(want)
    assert {(r["a_id"], r["b_id"]): r["count"] for r in pairs.collect()} == count
    assert Aligner(BYTES, PIECES).align("") is None


def test_long_texts_are_encoded_in_parts():
    draw = random.Random(7)
    base = "".join(draw.choice("ab  \n\t'sre1,.é日") for _ in range(30_000))
    for text in (base, " " * 5000 + base, base + "\n" * 9000 + "x", "z" * 12_000 + base):
        parts = list(windows(text, 1000))
        assert "".join(p for p, _ in parts) == text and len(parts) > 1
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        joined = [i for p, _ in parts for i in encoder(BYTES, special=False)(p).tolist()]
        assert joined == want


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "\n" * 2_000_000 + " y", "a" * 2_000_000,
                                  "word " * 300_000 + "\t" * 1_100_000 + "end"])
def test_long_white_space_is_encoded(text):
    ids = encoder(BYTES)(text)
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
