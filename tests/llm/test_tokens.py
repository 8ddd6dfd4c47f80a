"""Token counts and packing against the tokenizer library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tabular_audit.llm.packing import best_fill, pack, plan_windows
from tabular_audit.llm import token_counts as counting
from tabular_audit.llm.token_counts import Transducer, count_long, count_texts, token_counts
from tabular_audit.llm.vocabulary import encoder, vocabulary

from .conftest import ODD, by_id

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(texts):
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def random_texts(n):
    draw = random.Random(1)
    letters = "aetnrs  \n\t'sldmvr.,0123é ñüß\x1c\x85\xa0  中文日本😀'’½Ⅷ́\xad"
    out = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(n)]
    out += ["".join(chr(draw.choice([draw.randint(1, 0x250), draw.randint(1, 0x2FFF), draw.randint(32, 126)]))
                    for _ in range(30)) for _ in range(n)]
    return out + ["", "'s", "x<|endoftext|>y", "<|endoftext|>", "a" * 3000, "ab" * 700 + " " + "é" * 900,
                  " " * 700, "we're they'll I'd", "''s 's\n's", "<|endoftext|><|endoftext|>"]


def test_transducer_and_encoder_equal_the_library():
    texts = random_texts(1500)
    want = library_ids(texts)
    machine = Transducer(vocabulary(PATH))
    assert count_texts(texts, machine).tolist() == [len(w) for w in want]
    assert [encoder(PATH)(t).tolist() for t in texts] == want


def test_transducer_compiled_afresh_counts_the_same():
    texts = random_texts(200)
    machine = Transducer(vocabulary(PATH), most_states=50)
    first = count_texts(texts, machine)
    assert len(machine.states) > 50
    assert (count_texts(texts, machine) == first).all()


def border_free_texts():
    draw = random.Random(3)
    letters = ["".join(draw.choice("etaoinshr") for _ in range(200_000)), "a" * 150_000, "ab" * 70_000,
               "".join("lorem" if draw.random() < 0.9 else draw.choice("xyz") for _ in range(40_000))]
    return [*letters, "=" * 90_000, " " * 300_000, "\n" * 300_000 + "x", "é" * 50_000,
            "word " + letters[0][:5000] + " and " + "7" * 6000 + " end"]


def test_chunks_without_borders_equal_the_library():
    texts = border_free_texts()
    machine = Transducer(vocabulary(PATH))
    assert count_texts(texts, machine).tolist() == [len(i) for i in library_ids(texts)]


def test_chunks_from_true_entries_only(monkeypatch):
    monkeypatch.setattr(counting, "GUESSES", 1)
    texts = [t[:9000] for t in border_free_texts()]
    assert count_texts(texts, Transducer(vocabulary(PATH))).tolist() == [len(i) for i in library_ids(texts)]


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(counting, "PART", 1000)
    machine = Transducer(vocabulary(PATH))
    texts = [" ".join(t[:700] for t in border_free_texts()) * 3, "x<|endoftext|>" * 500,
             "".join(random_texts(300))]
    assert [count_long(t, machine) for t in texts] == [len(i) for i in library_ids(texts)]


def test_counts_of_documents(docs):
    found = by_id(token_counts(docs, PATH, limit=512))
    rows = docs.collect()
    for row, ids in zip(rows, library_ids([r["text"] for r in rows])):
        got = found[row["doc_id"]]
        assert (got["n_tokens"], got["n_bytes"]) == (len(ids), len(row["text"].encode()))
        assert got["over_limit"] == (len(ids) > 512)


def test_counts_of_odd_rows(spark, odd, long_text):
    out = token_counts(odd, PATH).collect()
    want = [len(i) for i in library_ids([r[1] for r in ODD])]
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == Counter(zip([r[0] for r in ODD], want))
    assert token_counts(odd.limit(0), PATH).count() == 0
    one = token_counts(spark.createDataFrame([(1, long_text)], "doc_id long, text string"), PATH).first()
    assert one["n_tokens"] == len(library_ids([long_text])[0])


def check_packing(rows, texts):
    """Pieces cover every document once; sequences have no gap and fit."""
    want = {}
    for text, ids in zip(texts, library_ids(texts)):
        want.setdefault(text or "", [*ids, 0])
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    padding = 0
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 1024 - at
    return want, padding


def test_packing_of_documents(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pack(docs, PATH).collect()
    want, padding = check_packing(rows, list(texts.values()))
    assert padding < 0.02 * sum(r["length"] for r in rows)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc_id, text in texts.items():
        ids, at = want[text], 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            part = np.array(ids[at:at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)


def test_packing_of_odd_rows(odd):
    rows = pack(odd, PATH).collect()
    want, _ = check_packing(rows, [r[1] for r in ODD])
    assert sum(r["length"] for r in rows) == sum(len(want[t or ""]) for _, t, *_ in ODD)
    assert pack(odd.limit(0), PATH).count() == 0


def test_a_frequent_length_leaves_little_padding(spark):
    ids = library_ids(["the cat " * 350])[0]
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('the cat ', 350) AS text")
    _, padding = check_packing(pack(docs, PATH).collect(), ["the cat " * 350])
    assert padding < 0.03 * 300 * len(ids)


def test_fills_are_best():
    draw = random.Random(2)
    for _ in range(200):
        counts = {draw.randint(1, 30): draw.randint(1, 3) for _ in range(5)}
        fill = best_fill(counts, 40)
        sums = {max(counts)}
        for length, n in counts.items():
            n -= length == max(counts)
            sums = {s + k * length for s in sums for k in range(n + 1)}
        assert sum(k * n for k, n in fill.items()) == max(s for s in sums if s <= 40)
        assert all(n <= counts[k] for k, n in fill.items())
        used = Counter()
        for times, pattern in plan_windows(counts, 40):
            used.update({k: n * times for k, n in pattern.items()})
        assert used == counts
