"""Token ids as Parquet list columns that can be read in part.

Rows stand in ascending document id over the files: texts are dealt by id ranges, sorted and encoded there.
``ids`` is dictionary encoded (a vocabulary fits one dictionary page), the number columns are delta encoded
(page format 2), row groups and pages are small enough that the page index skips most of a file for a range
of ids, and a reader that asks for counts never touches the ids.  Every file counts token starts from its own
first row; a manifest with one row per file has the offset of each, so no task needs to see them all.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm.tables import narrow
from recollect.llm.words import list_column, released, tidy
from recollect.plans.materialize import new_path

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1_000
#: Pieces that are kept, and the most bytes of a kept piece.
KEPT_WORDS, KEPT_CHARS = 150_000, 100
PIECES_AT_ONCE, STRINGS_AT_ONCE = 100, 64
#: Characters of text worked on at once: what is made of them in between takes tens of times as much.
PIECE_CHARS = 1_000_000
#: White space of Latin-1 besides the space and the controls that no library agrees on.
LATIN_BLANKS = "\t\n\v\f\r\xa0"
#: A mark between a letter or digit and a space is a word of its own.
LATIN_MARK = "([a-z0-9])([.,;:!?]) "
#: Pieces of printable ASCII.
PLAIN = "^[!-~]*$"


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``PIECE_CHARS`` bytes of text, so that what is made of the texts stays small."""
    for whole in batches:
        part = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy().astype(np.int64)) // PIECE_CHARS
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
        yield from (whole.slice(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False) if b > a)


class WordEncoder:
    """Encodes texts piece by piece between spaces, each distinct piece once a batch and seldom again while it is kept.

    Exact for tokenizers whose pre-tokenizer cuts normalised text with a pattern of letters, digits and other
    characters and drops white space, and whose tokens tell the end of a word; others are refused.  Texts in
    Latin-1 are lower-cased here and their new pieces cut into words; other texts are cut only at spaces and line ends,
    where no token and no normalisation reaches over.  Texts with a special token's string, or with controls that
    pattern libraries disagree on, are encoded by the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        cut = steps[0] if steps else {}
        pattern = cut.get("pattern", {}).get("Regex", "")
        kinds = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        ending = spec["model"].get("end_of_word_suffix")
        if cut.get("behavior") != "Removed" or not cut.get("invert") or "\\p{L}" not in pattern or kinds != ["NFC", "Replace", "Lowercase"] or not ending:
            raise ValueError(f"{path} does not cut lower-cased texts into words with marked ends")
        latin = [chr(i) for i in range(256)]
        letters = re.escape("".join(c for c in latin if unicodedata.category(c)[0] == "L"))
        digits = re.escape("".join(c for c in latin if unicodedata.category(c)[0] == "N"))
        self.cut = re.compile(pattern.replace("\\p{L}", letters).replace("\\p{N}", digits)).findall
        self.as_is = [*"\x1c\x1d\x1e\x1f\x85", *(t["content"] for t in spec["added_tokens"])]
        # printable ASCII in lower case is its own normal form and its own bytes: its words need no more than their spaces
        self.plain = Tokenizer.from_str(json.dumps({**spec, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(ending)]] = True
        self.none = np.zeros(0, dtype="<i4")
        self.kept = pa.array([], pa.large_string())
        self.ids, self.sizes, self.used = self.none, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def _whole(self, texts: list[str], plain: bool = False) -> list[np.ndarray]:
        """Ids of each string; few strings at a time, as what the tokenizer returns takes many times their bytes."""
        tokenizer, out = self.plain if plain else self.tokenizer, []
        for at in range(0, len(texts), STRINGS_AT_ONCE):
            found = tokenizer.encode_batch_fast(texts[at : at + STRINGS_AT_ONCE], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<i4") for e in found]
        return out

    def _marked(self, pieces: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-cased pieces of Latin-1 and how many each has; words go to the tokenizer many in a string."""
        alone = pc.ascii_is_alpha(pieces).to_numpy(zero_copy_only=False)
        words, texts = np.ones(len(pieces), dtype=np.int64), pieces.to_pylist()
        for i in np.flatnonzero(~alone).tolist():
            cut = self.cut(texts[i])
            words[i], texts[i] = len(cut), " ".join(cut)
        groups = [texts[i : i + PIECES_AT_ONCE] for i in range(0, len(texts), PIECES_AT_ONCE)]
        flat, sizes, at = [self.none], [np.zeros(0, dtype=np.int64)], 0
        for group, ids in zip(groups, self._whole([" ".join(g) for g in groups], plain), strict=True):
            ends, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(words[at : at + len(group)])
            at += len(group)
            if len(ends) == last[-1] and (ends[-1] if len(ends) else 0) == len(ids):  # words are told apart by their ends
                flat.append(ids)
                sizes.append(np.diff(np.concatenate([[0], ends])[last], prepend=0))
            else:
                each = self._whole(group)
                flat += each
                sizes.append(np.array([len(x) for x in each]))
        return np.concatenate(flat), np.concatenate(sizes)

    def _texts(self, texts: list[str], latin: bool) -> list[np.ndarray]:
        """Ids of each text, which is cut at its spaces; pieces that are not kept are encoded together."""
        whole = pa.array(texts, pa.large_string())
        if latin:
            whole = pc.replace_substring_regex(whole, LATIN_MARK, r"\1 \2 ")
        cut = pc.split_pattern(whole, " ")
        coded = cut.values.dictionary_encode()
        at = pc.index_in(coded.dictionary, self.kept).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        self.used[at[at >= 0]] = True
        pieces, found = coded.dictionary.take(pa.array(new)), [(self.ids, self.sizes)]
        if latin:
            plain = pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False)
            new, pieces = np.concatenate([new[plain], new[~plain]]), pieces.take(pa.array(np.argsort(~plain, kind="stable")))
            found += [self._marked(pieces[: plain.sum()], True), self._marked(pieces[plain.sum() :], False)]
        else:
            each = self._whole(pieces.to_pylist())
            found.append((np.concatenate([self.none, *each]), np.array([len(x) for x in each], dtype=np.int64)))
        at[new] = len(self.kept) + np.arange(len(new))
        ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        each = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(ids))
        taken = each.take(pa.array(at[coded.indices.to_numpy()]))
        self._keep(pieces, each, sizes)
        return np.split(taken.values.to_numpy(), taken.offsets.to_numpy()[cut.offsets.to_numpy()[1:-1]])

    def _keep(self, new: pa.Array, each: pa.LargeListArray, sizes: np.ndarray) -> None:
        """Keep the new pieces; of too many, those that were used again since the last time."""
        pieces = pa.concat_arrays([self.kept, new])
        used = np.concatenate([self.used, np.zeros(len(new), dtype=bool)])
        stay = pc.binary_length(pieces).to_numpy() <= KEPT_CHARS
        if len(pieces) > KEPT_WORDS:
            stay &= used
            if stay.sum() > KEPT_WORDS // 2:
                stay[:] = False
            used[:] = False
        if not stay.all():
            pieces, each, sizes, used = pieces.filter(pa.array(stay)), each.filter(pa.array(stay)), sizes[stay], used[stay]
        self.kept, self.ids, self.sizes, self.used = pieces, each.values.to_numpy(), sizes, used

    def encode_all(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Ids of each whole text, in parts."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: dict[bool, list[tuple[int, str]]] = {True: [], False: []}
        chars = 0

        def work() -> None:
            for latin, todo in waiting.items():
                if todo:
                    for (i, _), ids in zip(todo, self._texts([t for _, t in todo], latin), strict=True):
                        parts[i].append(ids)
                    todo.clear()

        for i, text in enumerate(texts):
            if any(x in text for x in self.as_is):
                parts[i].append(self._whole([text])[0])
                continue
            try:
                text.encode("latin-1")
                latin, plain = True, text.lower()
                for c in LATIN_BLANKS:
                    plain = plain.replace(c, " ")
            except UnicodeEncodeError:
                latin, plain = False, text.replace("\n", " ")
            at = 0
            while at < len(plain):
                end = len(plain) if len(plain) - at <= PIECE_CHARS else plain.rfind(" ", at, at + PIECE_CHARS) + 1
                if end <= at:
                    end = plain.find(" ", at) + 1 or len(plain)
                waiting[latin].append((i, plain[at:end]))
                chars += end - at
                at = end
                if chars > PIECE_CHARS:
                    work()
                    chars = 0
        work()
        return parts

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        return b"".join(x.tobytes() for x in self.encode_all([text])[0])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every text and write ``path``/tokens and ``path``/manifest.

    Null and empty texts are the end id alone.  Rows without an id come first, rows sharing an id stay next
    to each other, ordered by text hash; all are written.  An empty table gives files without rows.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    kind = dict(rows.dtypes)["doc_id"]

    @released
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start, file = encoder(tokenizer), 0, TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<i4")
        for batch in portions(batches):
            found = words.encode_all([t or "" for t in batch.column("text").to_pylist()])
            ids = [np.concatenate([*x, end]) for x in found]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(ids), file, dtype=np.int32)), pa.array(starts),
                 pa.array(sizes), list_column(ids, pa.int32())],
                names=["doc_id", "file", "start_in_file", "n_tokens", "ids"],
            )

    encoded = placed.mapInArrow(encode, f"doc_id {kind}, file int, start_in_file bigint, n_tokens bigint, ids array<int>")
    writer = encoded.write.option("compression", "zstd").option("parquet.writer.version", "v2")
    writer = writer.option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true")
    writer = writer.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes))
    writer.option("parquet.page.row.count.limit", str(page_rows)).parquet(f"{path}/tokens")
    sizes = docs.sparkSession.read.schema(encoded.schema).parquet(f"{path}/tokens").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    manifest = sizes.select("file", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    manifest.write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents from ``first`` to ``last``; without ``ids`` only the counts are read.

    ``start`` counts the ids of all documents before, in the whole set of files.
    """
    rows = spark.read.parquet(f"{path}/tokens")
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    offsets = spark.read.parquet(f"{path}/manifest").select("file", F.col("start").alias("offset"))
    columns = ["doc_id", (F.col("offset") + F.col("start_in_file")).alias("start"), "n_tokens"] + ["ids"] * ids
    return rows.join(offsets, "file").select(*columns)


def with_checksum(tokens: DataFrame) -> DataFrame:
    """Rows of ``read_tokens`` with the unsigned crc32 of their ids in place of the ids."""

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy().tolist()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.mapInArrow(check, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = new_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer)
    return with_checksum(read_tokens(docs.sparkSession, path))
