"""Token counts from a compiled finite-state tokenizer.

A BPE tokenization is the one way to cut a text into pieces in which every two neighbours stay apart when they
are tokenized by themselves.  So the last piece of every prefix is determined by the pieces that end in the
reach of the longest vocabulary prefix at that place, and reading one more character is a step of a
deterministic transducer: its state is that vocabulary prefix with the last pieces (and relative counts) at
the places it covers; its output is by how much the token count changes.  States and transitions are compiled
when a text first needs them and kept up to a bound.

Text is worked on in chunks.  No piece has a word character before a space, so a transducer that meets a
space after a word is in the same state whatever came before.  A chunk's state map is therefore: the
characters before its first such place, the count from there on, and the state at its end.  Maps of the chunks
of a text compose associatively; their prefix scan gives the count of the whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.tables import narrow

#: The space symbol of the vocabulary, a fixed value.
SPACE = "▁"
CHUNK_CHARS = 65_536
KEPT_STATES = 150_000
KEPT_WORDS = 300_000

Key = tuple[str, tuple[tuple[str | None, int], ...]]


class State:
    """Vocabulary prefix at hand, (last piece, count relative to here) at each place it covers, known steps."""

    __slots__ = ("prefix", "past", "steps")

    def __init__(self, key: Key):
        self.prefix, self.past = key
        self.steps: dict[str, tuple[State, int]] = {}

    @property
    def key(self) -> Key:
        return self.prefix, self.past


START: Key = ("", ((None, 0),))
#: A place where no later token can begin.
UNUSED = (None, 0)


class Transducer:
    """Lazily compiled token counter for a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._require(model)
        self.scores = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        self.beginnings = {p[:i] for p in self.scores for i in range(1, len(p))}
        self.inside = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        if any(pair[1] == SPACE and pair[0] != SPACE for pair in self.inside):
            raise ValueError("pieces with a space after a word are not supported")
        self.tokens = {p for p in self.scores if self.merge(p) == [p]}
        self.apart: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}
        self.states: dict[Key, State] = {}

    @staticmethod
    def _require(model) -> None:
        spec = model.serialized_model_proto()
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(spec)
        n, t = proto.normalizer_spec, proto.trainer_spec
        plain = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces
        if t.model_type != t.BPE or not t.byte_fallback or not plain or t.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and without normalisation are supported")

    # ---- the rules

    def merge(self, text: str) -> list[str]:
        """Tokenize a short text by its definition: the best-scored neighbours merge first, leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, a: str, b: str) -> bool:
        if a[-1] + b[0] not in self.inside:
            return True
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > KEPT_WORDS:
                self.apart.clear()
            known = self.apart[a, b] = self.merge(a + b) == [a, b]
        return known

    # ---- states

    def state(self, key: Key) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(key)
        return found

    def compile_step(self, state: State, char: str) -> tuple[State, int]:
        """The transition on ``char``: next state and change of the token count."""
        if char not in self.scores:  # its bytes are tokens, and nothing merges with them
            step = self.state(START), len(char.encode("utf-8", "surrogatepass"))
        else:
            text, past, tokens, beginnings = state.prefix + char, state.past, self.tokens, self.beginnings
            size = len(text)
            for k in range(size):
                piece = text[k:]
                if piece in tokens:
                    last, behind = past[k]
                    if last is None or self.stay_apart(last, piece):
                        break
            else:
                raise AssertionError(f"no token ends at {text!r}")
            change, keep, own = behind + 1, size, []
            for i in range(size):
                if text[i:] in beginnings:  # a later token may begin here
                    keep = min(keep, i)
                    a, c = past[i]
                    own.append((a if a is not None and a[-1] + text[i] in self.inside else None, c - change))
                elif keep < size:
                    own.append(UNUSED)
            step = self.state((text[keep:], (*own, (piece, 0)))), change
        state.steps[char] = step
        return step

    def run(self, state: State, text: str) -> tuple[State, int]:
        count = 0
        for char in text:
            step = state.steps.get(char)
            if step is None:
                step = self.compile_step(state, char)
            state = step[0]
            count += step[1]
        return state, count

    def trim(self) -> None:
        """Forget what is compiled once it exceeds the bound; it is compiled again when needed."""
        if len(self.states) > KEPT_STATES:
            self.states.clear()
        if len(self.words) > KEPT_WORDS:
            self.words.clear()

    # ---- texts and chunks

    def segment(self, text: str) -> int:
        return self.run(self.state(START), text)[1]

    def words_count(self, words: list[str]) -> int:
        """Tokens of words with one space before each; empty words are further spaces."""
        total, spaces, known = 0, 0, self.words
        for w in words:
            if not w:
                spaces += 1
            elif spaces:
                total += self.segment(SPACE * (spaces + 1) + w)
                spaces = 0
            else:
                count = known.get(w)
                if count is None:
                    count = self.segment(SPACE + w)
                    if len(w) < 64:
                        known[w] = count
                total += count
        return total + (self.segment(SPACE * spaces) if spaces else 0)

    def count(self, text: str) -> int:
        if not text:
            return 0
        self.trim()
        return self.words_count(text.replace(SPACE, " ").split(" "))

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """State map of a chunk (spaces as ``SPACE``): head, count after it, state at the end.

        A chunk without a place that fixes the state is all head, with no state.
        """
        self.trim()
        at = next((i for i in range(1, len(chunk)) if chunk[i] == SPACE and chunk[i - 1] != SPACE), None)
        if at is None:
            return chunk, 0, None
        last = max(i for i in range(at, len(chunk)) if chunk[i] == SPACE and (i == at or chunk[i - 1] != SPACE))
        middle = self.words_count(chunk[at + 1 : last].replace(SPACE, " ").split(" ")) if last > at else 0
        state, tail = self.run(self.state(START), chunk[last:])
        return chunk[:at], middle + tail, json.dumps(state.key)

    def compose(self, maps: list[tuple[str, int, str | None]]) -> int:
        """The count of a text from the maps of its chunks in order."""
        state, total = self.state(START), 0
        for head, count, end in maps:
            state, more = self.run(state, head)
            total += more + count
            if end is not None:
                prefix, past = json.loads(end)
                state = self.state((prefix, tuple((a, c) for a, c in past)))
        return total


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def token_counts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_bytes`` (UTF-8) and ``n_tokens``, without begin or end tokens.

    Null and empty texts have none.  Every row gives one row, repeated and null ids included.  Texts over
    ``chunk_chars`` code points are dealt out chunk by chunk.  Other columns are not passed on; an empty table gives none.
    """
    rows = narrow(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    kind = dict(rows.dtypes)["id"]
    carry = ("row", "id", "n_bytes")
    long = F.coalesce(F.char_length("text") > chunk_chars, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = transducer(model)
        for batch in batches:
            counts = [counter.count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = (SPACE + text).replace(" ", SPACE)
                chunks = [text[at : at + chunk_chars] for at in range(0, len(text), chunk_chars)]
                same = pa.array([i] * len(chunks))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(same) for c in carry), pa.array(range(len(chunks)), pa.int32()), pa.array(chunks)],
                    names=[*carry, "place", "chunk"],
                )

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = transducer(model)
        for batch in batches:
            found = [counter.chunk_map(c) for c in batch.column("chunk").to_pylist()]
            kinds = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*carry, "place")), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))],
                names=[*carry, "place", "head", "count", "end"],
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = transducer(model)
        for batch in batches:
            counts = [counter.compose([(m["head"], m["count"], m["end"]) for m in row]) for row in batch.column("maps").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    sized = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    short = sized.filter(~long).select("id", "text", "n_bytes").mapInArrow(whole, f"id {kind}, n_bytes bigint, n_tokens bigint")
    named = f"row bigint, id {kind}, n_bytes bigint, place int"
    chunks = sized.filter(long).select(*carry, "text").mapInArrow(split, f"{named}, chunk string")
    mapped = chunks.repartition("row", "place").mapInArrow(maps, f"{named}, head string, count bigint, end string")
    in_order = mapped.groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"),
        F.array_sort(F.collect_list(F.struct("place", "head", "count", "end"))).alias("maps"),
    )
    chunked = in_order.mapInArrow(scan, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return short.unionByName(chunked).withColumnRenamed("id", id_col)


def count_digest(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    counted = token_counts(docs, model)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
