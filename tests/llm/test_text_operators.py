"""Line dedup, phrases, token counts and token files against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recollect.llm import lines, phrases, tokencounts, tokenfiles
from recollect.plans.materialize import new_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- line dedup


def lines_by_hand(rows):
    key = lambda line: low(line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    holders[key(line)].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if i is None or len(holders[key(x)]) < 2 or i == min(holders[key(x)])]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_equal_plain_python(odd_documents, odd_texts, no_documents):
    got = lines.line_digest(odd_documents)
    assert sorted(map(tuple, got.collect()), key=repr) == lines_by_hand(odd_texts)
    assert lines.line_digest(no_documents).count() == 0


def test_lines_keep_other_columns(odd_documents):
    got = lines.dedup_lines(odd_documents)
    assert [c.lower() for c in got.columns].count("n_lines") == 1 and "tie" in got.columns
    assert got.count() == odd_documents.count()


def test_lines_over_a_higher_threshold(spark):
    rows = [(i, "a line that is shared\nline number " + str(i)) for i in range(3)] + [(9, "other shared line"), (10, "other shared line")]
    got = {r.doc_id: r.kept_text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), max_documents=2).collect()}
    assert got[0].startswith("a line") and got[1] == "line number 1" and got[10] == "other shared line"


# ---- phrases

ITEMS = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short one"), (3, ""), (4, None), (None, "no id here at all"),
         (2, "second text"), (5, "!!!"), (10, "kappa")]
HITS = [
    (1, "so ALPHA beta gamma-delta epsilon zeta eta theta iota kappa lambda mu end"), (2, "beta gamma delta epsilon zeta eta theta iota kappa"),
    (3, "a short one and a short two second text short one"), (4, None), (5, ""), (None, "short one"), (3, "short one"), (6, "no id here at all"),
    (7, "nothing to see"), (8, "short, one" * 3000), (9, "alpha beta x gamma delta epsilon zeta eta theta iota kappa"),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def phrases_by_hand(rows, items, window=10):
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            g = words(text)
            for a in range(max(1, len(g) - window + 1) if g and item is not None else 0):
                part = g[a : a + window]
                for b in range(len(w) - len(part) + 1):
                    if w[b : b + len(part)] == part:
                        hit.update(range(b, b + len(part)))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_bytes", [1_000_000, 40])
def test_phrases_equal_plain_python(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(phrases.phrase_hits, "__defaults__", (10, 0, slice_bytes))
    docs = spark.createDataFrame(HITS, "doc_id bigint, text string").coalesce(2)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert sorted(map(tuple, phrases.contamination_digest(docs, items).collect()), key=repr) == phrases_by_hand(HITS, ITEMS)


def test_phrases_on_odd_tables(spark, odd_documents, odd_texts, no_documents):
    items = [(1, odd_texts[0][1]), (2, "line of seven here")]
    made = spark.createDataFrame(items, "item_id bigint, text string")
    got = phrases.contamination_digest(odd_documents, made)
    assert sorted(map(tuple, got.collect()), key=repr) == phrases_by_hand(odd_texts, items)
    assert phrases.contamination_digest(no_documents, made).count() == 0
    none = phrases.contamination_digest(odd_documents, made.limit(0)).collect()
    assert len(none) == len(odd_texts) and not any(r.contaminated for r in none)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red big fox"), (2, "red fox"), (3, "red a b c fox")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "red fox")], "item_id bigint, text string")
    near = {r.doc_id: r.n_items for r in phrases.decontaminate(docs, items, slop=1).collect()}
    assert near == {1: 1, 2: 1, 3: 0}


def test_proximity_of_windows_outside_the_text(spark):
    docs = spark.createDataFrame([(1, "fox"), (2, "red fox")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "fox")], "item_id bigint, text string")
    found = {r.doc_id: (r.n_items, r.n_hit, list(zip(r.starts, r.ends, strict=True))) for r in phrases.decontaminate(docs, items, slop=3).collect()}
    assert found == {1: (1, 1, [(0, 1)]), 2: (1, 2, [(0, 2)])}


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_equals_trying_every_start(spark, slop):
    r = random.Random(slop)
    texts = [(i, " ".join(r.choice("abcdef") for _ in range(r.randint(0, 14)))) for i in range(80)]
    parts = [(i, " ".join(r.choice("abcdef") for _ in range(r.randint(1, 6)))) for i in range(12)]
    want = {}
    for d, text in texts:
        words, hit, found = text.split(), set(), set()
        for i, part in parts:
            whole = part.split()
            for at in range(max(1, len(whole) - 3)):
                window = whole[at : at + 4]
                for s in range(-slop, len(words) - len(window) + slop + 1):
                    if all(any(0 <= p < len(words) and words[p] == w for p in range(s + o - slop, s + o + slop + 1)) for o, w in enumerate(window)):
                        found.add(str(i))
                        hit.update(range(max(0, s), min(len(words), s + len(window))))
        want[d] = (sorted(found), len(hit))
    docs, items = (spark.createDataFrame(x, f"{n} bigint, text string") for x, n in ((texts, "doc_id"), (parts, "item_id")))
    got = {x.doc_id: (list(x["items"]), x.n_hit) for x in phrases.decontaminate(docs, items, window=4, slop=slop).collect()}
    assert got == want and any(n for _, n in want.values())


# ---- token counts


@pytest.fixture(scope="module")
def pieces():
    return tokencounts.Transducer(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60), size=st.integers(1, 12))
def test_transducer_equals_the_library(text, size):
    machine, library = tokencounts.transducer(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = len(library.encode(text))
    assert machine.count(text) == want
    whole = (tokencounts.SPACE + text).replace(" ", tokencounts.SPACE) if text else ""
    assert machine.compose([machine.chunk_map(whole[i : i + size]) for i in range(0, len(whole), size)]) == want


def test_transducer_on_likely_text(pieces):
    machine, library = pieces
    r = random.Random(3)
    parts = ["the ", "tion", "ing", " ", "  ", "\n", "é", "x" * 20, "▁", "日", "12", ",", "Schl", "üss", "el", "\x00"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert machine.count(text) == len(library.encode(text))


def test_transducer_forgets_and_stays_right(pieces, monkeypatch):
    machine, library = pieces
    monkeypatch.setattr(tokencounts, "KEPT_STATES", 10)
    monkeypatch.setattr(tokencounts, "KEPT_WORDS", 10)
    for text in ("some words to count", "other words entirely", "some words to count"):
        assert machine.count(text) == len(library.encode(text))


@pytest.mark.parametrize("chunk", [50, 65_536])
def test_counts_of_odd_documents(odd_documents, odd_texts, no_documents, pieces, chunk):
    library = pieces[1]
    got = tokencounts.token_counts(odd_documents, PIECES, chunk_chars=chunk).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in odd_texts]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokencounts.token_counts(no_documents, PIECES).count() == 0


# ---- token files


def test_token_files_round_trip(spark, odd_documents, odd_texts, no_documents):
    library = Tokenizer.from_file(WORDS)
    got = tokenfiles.token_digest(odd_documents, WORDS).collect()
    want = defaultdict(list)
    for i, t in odd_texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[i].append((len(ids), zlib.crc32(ids.tobytes())))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert tokenfiles.token_digest(no_documents, WORDS).count() == 0


def test_token_files_are_encoded_and_read_in_part(spark, odd_documents):
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(odd_documents, path, WORDS)
    import glob

    meta = next(m for f in glob.glob(f"{path}/tokens/*.parquet") if (m := pq.ParquetFile(f).metadata).num_rows)
    kinds = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "RLE_DICTIONARY" in kinds["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in kinds["n_tokens"].encodings
    assert all(c.has_offset_index for c in kinds.values())
    part = tokenfiles.read_tokens(spark, path, 7, 9, ids=False)
    assert sorted(r.doc_id for r in part.collect()) == [7, 8, 9]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,7)" in plan


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab'sSt \n\t12.<|>")), st.characters(codec="utf-8")), max_size=60))
def test_word_encoder_equals_the_library(text):
    want = np.array(Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes() if text else b""
    assert tokenfiles.encoder(WORDS).encode(text) == want


@pytest.mark.parametrize(("kept", "chars"), [(200_000, 4_000_000), (20, 50)])
def test_word_encoder_forgets_and_stays_right(monkeypatch, kept, chars):
    monkeypatch.setattr(tokenfiles, "KEPT_WORDS", kept)
    monkeypatch.setattr(tokenfiles, "PIECE_CHARS", chars)
    library, words, r = Tokenizer.from_file(WORDS), tokenfiles.WordEncoder(WORDS), random.Random(4)
    parts = ["the ", "Tion", "ing, ", "?! ", "  ", "\n", "\t", "é", "\xa0", "'s", "don't ", "\x00", "日", "12", ".", "<|ENDOFTEXT|>", "<|endoftext|>", "\x85"]
    for _ in range(20):
        texts = ["".join(r.choice(parts[: r.choice([14, len(parts)])]) for _ in range(r.randint(0, 40))) for _ in range(50)]
        assert [np.concatenate([*x, []]).tolist() for x in words.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(words.kept) <= kept


def test_word_encoder_keeps_little_memory(monkeypatch):
    words = tokenfiles.WordEncoder(WORDS)
    for k in range(4):
        words.encode_all([" ".join(f"word{i}x" for i in range(k * 90_000, (k + 1) * 90_000))])
    assert words.kept.nbytes + words.ids.nbytes + words.sizes.nbytes < 20_000_000


def test_word_encoder_hands_the_tokenizer_few_strings_at_once(monkeypatch):
    class Watched:
        def __init__(self, tokenizer):
            self.tokenizer, self.most = tokenizer, 0

        def encode_batch_fast(self, texts, **options):
            self.most = max(self.most, len(texts))
            return self.tokenizer.encode_batch_fast(texts, **options)

    words, text = tokenfiles.WordEncoder(WORDS), " ".join(f"word{i}x" for i in range(30_000))
    words.plain = watched = Watched(words.plain)
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.encode(text), "<i4").tolist() == want
    assert 0 < watched.most <= 64 and tokenfiles.PIECE_CHARS <= 1_000_000


def test_texts_are_worked_on_in_portions(monkeypatch):
    monkeypatch.setattr(tokenfiles, "PIECE_CHARS", 10)
    texts = ["a" * 4, None, "b" * 9, "c" * 30, "", "d"]
    whole = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    found = [b.column("text").to_pylist() for b in tokenfiles.portions(iter([whole, whole.slice(0, 0)]))]
    assert [t for p in found for t in p] == texts and len(found) > 2


def test_word_encoder_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        tokenfiles.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
