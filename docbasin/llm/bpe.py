"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

Encoding. In a BPE vocabulary whose tokens encode to themselves, a segmentation is *the* BPE encoding exactly if every
two neighbours are compatible, that is, if encoding their concatenation gives the two back. So each prefix of an input
has one last token, and the input can be read from left to right. What later bytes can still depend on is small: the places
where the token that is open now may have begun (the bytes since are a proper prefix of some token), and the last token
before each. That is a state of the transducer; a move reads a byte and writes the last token of the prefix so far.
A token is settled once it lies on the paths of all these places, so the lookahead is bounded by the longest token.
States and moves are made when first needed and kept, up to a bound; past the bound the table starts afresh.

Decoding. Tokens drive an automaton over UTF-8 well-formedness (the table of the Unicode standard, 3-7); its states are
the bytes that wait, and the moves of whole tokens are composed when first needed. It gives out complete characters
only, and U+FFFD for ill-formed bytes. What op10 hashes as decoded is what this decoder gives out.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from docbasin.llm.common import arrow, pieces, read, trim

#: Bounds of a task's tables: states of the transducer, and words in each of two generations of kept encodings.
MAX_STATES = 200_000
MAX_WORDS = 150_000
#: A stage among others keeps so many times fewer: its workers have served the stages before.
STAGE_SHARE = 4
#: Moves of the decoder that are kept: a state and a token each.
MAX_MOVES = 100_000
#: Bits of a token in a move of the transducer, which is one number: the next state, then the token.
TOKEN_BITS = 24
TOKEN = (1 << TOKEN_BITS) - 1
#: Input bytes between two looks for settled tokens.
STRIDE = 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Compiled ranks. `encode(bytes)` gives the ids that merging by rank gives."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self.open = {token[:i] for token in ranks for i in range(1, len(token))}
        #: Of each token the two it was joined from (itself, for bytes), and of each such pair what it is joined to.
        self.halves = [(i, i) for i in range(len(self.bytes_of))]
        for token, rank in ranks.items():
            if len(token) > 1:
                left, right = self.merged(token, until=2)
                self.halves[rank] = (left, right)
        self.joined = {pair: rank for rank, pair in enumerate(self.halves) if pair[0] != pair[1] or len(self.bytes_of[rank]) > 1}
        #: One object for each id: encodings that are kept share them.
        self.own = list(range(len(self.bytes_of)))
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.about: list[tuple] = []
        self.moves: dict[int, int] = {}
        self._state((b"", (), -1))

    def _state(self, key: tuple) -> int:
        """key: the bytes since the first open place, the last token before each open place, the last token of all."""
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.about)
            self.about.append(key)
        return at

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """The plain definition: join the neighbours of least rank, the leftmost first, until none can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, a: int, b: int) -> bool:
        """Whether encoding a's and b's bytes together gives a and b again.

        Their merges are undone, the latest first; in between, a pair across the border that joins earlier than the
        merge just undone (at the same rank, the left one goes first) would have been taken instead.
        """
        if a < 0:
            return True
        halves, joined, before = self.halves, self.joined, 1 << 60
        while True:
            if joined.get((a, b), 1 << 60) < before:
                return False
            left_done, right_done = halves[a][1] == a, halves[b][0] == b
            if left_done and right_done:
                return True
            if right_done or (a > b and not left_done):
                before, a = a, halves[a][1]
            else:
                before, b = b + 1, halves[b][0]

    def _open(self, rest: bytes) -> list[int]:
        return [i for i in range(len(rest)) if rest[i:] in self.open]

    def _move(self, at: int, byte: int) -> int:
        """The next state and the last token once `byte` is read, in one number."""
        rest, before, last = self.about[at]
        places = [*zip(self._open(rest), before, strict=True), (len(rest), last)]
        rest += bytes([byte])
        for begin, left in places:
            token = self.ranks.get(rest[begin:])
            if token is not None and self._fits(left, token):
                break
        else:
            raise ValueError(f"no token ends at byte {byte}: the vocabulary lacks it")
        places = [(i, left) for i, left in places if rest[i:] in self.open]
        first = places[0][0] if places else len(rest)
        to = self._state((rest[first:], tuple(left for _, left in places), token))
        step = self.moves[at << 8 | byte] = to << TOKEN_BITS | token
        return step

    def _path(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(lasts[end - 1])
            end -= len(self.bytes_of[lasts[end - 1]])
        return out[::-1]

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of a stream of bytes, each given out once it is settled."""
        at, lasts, moves = 0, [], self.moves
        for byte in data:
            step = moves.get(at << 8 | byte)
            if step is None:
                step = self._move(at, byte)
            at = step >> TOKEN_BITS
            lasts.append(step & TOKEN)
            if len(lasts) % STRIDE == 0:
                ends = {len(lasts)} | {len(lasts) - len(self.about[at][0]) + i for i in self._open(self.about[at][0])}
                while len(ends) > 1:  # back to the last place that all paths have in common
                    end = max(ends)
                    ends.remove(end)
                    ends.add(end - len(self.bytes_of[lasts[end - 1]]))
                cut = ends.pop()
                yield from self._path(lasts, cut)
                del lasts[:cut]
                if len(self.about) > self.max_states:
                    key = self.about[at]
                    self._clear()
                    at, moves = self._state(key), self.moves
        yield from self._path(lasts, len(lasts))

    def encode(self, data: bytes) -> tuple[int, ...]:
        if len(self.about) > self.max_states:
            self._clear()
        if len(data) >= STRIDE:
            return tuple(map(self.own.__getitem__, self.stream(data)))
        at, lasts, moves = 0, [], self.moves
        for byte in data:
            step = moves.get(at << 8 | byte)
            if step is None:
                step = self._move(at, byte)
            at = step >> TOKEN_BITS
            lasts.append(step & TOKEN)
        return tuple(map(self.own.__getitem__, self._path(lasts, len(lasts))))


#: Fixed values of UTF-8: lead byte range -> allowed ranges of the bytes that follow.
UTF8 = [
    ((0x00, 0x7F), []),
    ((0xC2, 0xDF), [(0x80, 0xBF)]),
    ((0xE0, 0xE0), [(0xA0, 0xBF), (0x80, 0xBF)]),
    ((0xE1, 0xEC), [(0x80, 0xBF), (0x80, 0xBF)]),
    ((0xED, 0xED), [(0x80, 0x9F), (0x80, 0xBF)]),
    ((0xEE, 0xEF), [(0x80, 0xBF), (0x80, 0xBF)]),
    ((0xF0, 0xF0), [(0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)]),
    ((0xF1, 0xF3), [(0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)]),
    ((0xF4, 0xF4), [(0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)]),
]


@lru_cache(maxsize=1)
def utf8_automaton() -> dict[tuple, list]:
    """State (the ranges still due) -> for each byte the next state, or None where the byte can't follow."""
    table: dict[tuple, list] = {}
    todo = [()]
    while todo:
        state = todo.pop()
        if state in table:
            continue
        row: list = [None] * 256
        for (lo, hi), rest in UTF8 if not state else [(state[0], list(state[1:]))]:
            for byte in range(lo, hi + 1):
                row[byte] = tuple(rest)
        table[state] = row
        todo += {r for r in row if r is not None}
    return table


class Waiting(dict):
    """The decoder's moves while `held`, the bytes of an unfinished character, wait: id -> the text given out, the moves from then on.

    A move runs the token's bytes through the automaton when it is first needed. An ill-formed sequence gives one U+FFFD
    for its longest beginning that could have been well-formed.
    """

    def __init__(self, held: bytes, bytes_of: list[bytes], rows: dict[bytes, Waiting]):
        super().__init__()
        self.held, self.bytes_of, self.rows = held, bytes_of, rows
        rows[held] = self

    def __missing__(self, i: int) -> tuple[str, Waiting]:
        table, state, held, out = utf8_automaton(), (), b"", []
        for byte in self.held:
            state = table[state][byte]
        held = self.held
        for byte in self.bytes_of[i]:
            to = table[state][byte]
            if to is None and held:
                out.append("\ufffd")
                held, state = b"", ()
                to = table[state][byte]
            if to is None:
                out.append("\ufffd")
                continue
            held, state = held + bytes([byte]), to
            if not to:
                out.append(held.decode())
                held = b""
        row = self.rows.get(held)
        step = self[i] = ("".join(out), Waiting(held, self.bytes_of, self.rows) if row is None else row)
        return step


class StreamingDecoder:
    """Ids in, complete characters out; bytes of an unfinished character wait for the next ids."""

    def __init__(self, bytes_of: list[bytes], max_moves: int = MAX_MOVES):
        self.bytes_of, self.max_moves = bytes_of, max_moves
        self.rows: dict[bytes, Waiting] = {}
        self.row = Waiting(b"", bytes_of, self.rows)

    def feed(self, ids: Iterable[int]) -> str:
        if sum(map(len, self.rows.values())) > self.max_moves:
            self.rows = {}
            self.row = Waiting(self.row.held, self.bytes_of, self.rows)
            if b"" not in self.rows:
                Waiting(b"", self.bytes_of, self.rows)
        row, out = self.row, []
        for i in ids:
            text, row = row[i]
            out.append(text)
        self.row = row
        return "".join(out)

    def finish(self) -> str:
        rest, self.row = "\ufffd" * bool(self.row.held), self.rows[b""]
        return rest


class Tokenizer:
    """Pattern and transducer together; encodings of words are kept, up to a bound."""

    def __init__(self, path: str, pattern: str, max_words: int = MAX_WORDS, max_states: int = MAX_STATES):
        self.fst = Transducer(load_ranks(path), max_states)
        self.find = regex.compile(pattern).findall
        self.max_words, self.kept, self.older = max_words, {}, {}
        self.names = [str(i) for i in range(len(self.fst.bytes_of))]
        self.decoder = StreamingDecoder(self.fst.bytes_of)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        young = self.kept.get
        for word in self.find(text):
            out += young(word) or self._encode(word)
        return out

    def _encode(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.fst.encode(word.encode())
        if len(word) <= 64:
            if len(self.kept) >= self.max_words:
                self.older = dict(self.kept)
                self.kept.clear()
            self.kept[word] = ids
        return ids

    def forget(self) -> None:
        """Drops what the texts so far have filled; the compiled ranks stay. Workers outlive tasks and serve other stages too."""
        self.kept, self.older = {}, {}
        self.fst._clear()
        self.decoder = StreamingDecoder(self.fst.bytes_of)
        gc.collect()  # the tables refer to each other

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of a whole sequence, by the streaming decoder."""
        return (self.decoder.feed(ids) + self.decoder.finish()).encode()


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str, max_words: int = MAX_WORDS, max_states: int = MAX_STATES) -> Tokenizer:
    return Tokenizer(path, pattern, max_words, max_states)


def encode(docs: DataFrame, path: str, pattern: str, *, ids: bool = False) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, exact (whether the decoded bytes are the text's); with `ids`, the array token_ids too.

    One pass over the scan, no shuffle: memory is a bounded piece of a batch plus a worker's tables, which are bounded
    and serve its later tasks too. (`tokens`, a stage among others, lets go of them at a task's end.)
    A null text counts as empty: no tokens. Rows are independent, so repeated rows give repeated results; other columns
    of `docs` are ignored, whatever their names.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean" + ", token_ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        name = tok.names.__getitem__
        for piece in pieces(batches):
            out: dict[str, list] = {c: [] for c in ("n_tokens", "ids_sha256", "decoded_sha256", "exact", "token_ids")}
            for text in piece["text"].to_pylist():
                found = tok.encode(text or "")
                out["n_tokens"].append(len(found))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(name, found)).encode()).hexdigest())
                back = tok.decode(found)
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                out["exact"].append(back == (text or "").encode())
                if ids:
                    out["token_ids"].append(found)
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
            columns = [pa.array(out[c], t) for c, t in zip(out, types, strict=True)][: 4 + ids]
            yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), *columns], names=["doc_id", *out][: 5 + ids])

    return arrow(docs.select("doc_id", "text")).mapInArrow(run, schema)


def tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs` with its text encoded: all other columns, n_tokens and token_ids. Null texts have no tokens."""
    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "token_ids")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*rest).dtypes), "n_tokens long", "token_ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern, MAX_WORDS // STAGE_SHARE, MAX_STATES // STAGE_SHARE)
        for piece in pieces(batches):
            found = [tok.encode(t or "") for t in piece["text"].to_pylist()]
            for text, ids in zip(piece["text"].to_pylist(), found, strict=True):
                if tok.decode(ids) != (text or "").encode():
                    raise ValueError("a text doesn't come back from its tokens")
            yield pa.RecordBatch.from_arrays([*(piece[c] for c in rest), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=[*rest, "n_tokens", "token_ids"])
        tok.forget()
        trim()

    return arrow(docs.select("text", *rest)).mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact")
