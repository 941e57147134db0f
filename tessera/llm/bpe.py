"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes.

For every prefix of a piece there is one last token of its encoding: the vocabulary token
that ends there and may stand after the last token of what is left of it (a pair may
stand together if merging its bytes gives back that pair). A state of the transducer
holds, for each position from which a token may still be open, the tokens of the
encoding up to there; what all of these paths begin with is certain and is emitted, so a
token comes out after a bounded lookahead. States and transitions are made when a byte
first needs them and then kept, up to ``MAX_STATES``; whole pieces are remembered up to
``MAX_PIECES``. Both bounds only limit memory: what is forgotten is worked out again.

The vocabulary is a file of ``base64-token rank`` lines, read on the driver and sent to
the tasks. A piece that is itself a token is that token; ranks decide every merge.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read
from tessera.llm.kernels import tidied

MAX_STATES, MAX_PIECES = 300_000, 1_000_000


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line.strip())}


def split_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode's White_Space property, whatever the regex library takes \\s for."""
    pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE of a short byte string: join the adjacent pair of lowest rank, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class _State:
    __slots__ = ("last", "open", "moves")

    def __init__(self, last: int, open_: tuple) -> None:
        self.last = last  # the last token that was emitted, or -1
        self.open = open_  # (trie node of the bytes since a position, tokens up to it that aren't emitted yet), ..., here
        self.moves: dict[int, tuple[_State, tuple[int, ...]]] = {}


class Transducer:
    """Encodes pieces byte by byte."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.child: dict[int, int] = {}  # node * 256 + byte: node
        self.at: list[int] = [-1]  # node: token, if its bytes merge to it
        self.parts: dict[int, tuple[bytes, bytes] | None] = {}  # token: the two parts of its last merge
        self.edges: tuple[dict, dict] = ({}, {})
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.child.setdefault(key, len(self.at))
                if node == len(self.at):
                    self.at.append(-1)
            self.at[node] = rank
        self.token = {r: t for t, r in ranks.items()}
        self.leaf = [True] * len(self.at)
        for key in self.child:
            self.leaf[key >> 8] = False
        self.clear()

    def clear(self) -> None:
        """Forget all states, and cut their circles of references."""
        if getattr(self, "states", None):
            for state in self.states.values():
                state.moves = {}
        self.states: dict[tuple, _State] = {}
        self.pairs: dict[int, bool] = {}
        self.start = self._state(-1, ((0, ()),))

    def _state(self, last: int, open_: tuple) -> _State:
        state = self.states.get((last, open_))
        if state is None:
            state = self.states[last, open_] = _State(last, open_)
        return state

    def _last_merge(self, token: int) -> tuple[bytes, bytes] | None:
        """The two parts that the last merge of the token's bytes joins; None for a byte, () if they don't give it."""
        if token not in self.parts:
            parts, whole = [self.token[token][i : i + 1] for i in range(len(self.token[token]))], None
            while len(parts) > 1:
                best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == 1 << 60:
                    whole = ()
                    break
                whole = tuple(parts[at : at + 2])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.parts[token] = whole
        return self.parts[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that stand at an edge of the token in the course of its merges, with the ranks between which they do."""
        known = self.edges[side].get(token)
        if known is not None:
            return known
        spans, until, of = [], 1 << 60, token
        while True:
            parts = self._last_merge(token)
            spans.append((self.token[token], -1 if parts is None else token, until))
            if parts is None:
                self.edges[side][of] = spans
                return spans
            token, until = self.ranks[parts[side]], token

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether no merge joins a part at the end of ``left`` with one at the start of ``right`` while both stand."""
        key = left << 32 | right
        ok = self.pairs.get(key)
        if ok is None:
            ok, starts = True, self._edge(right, 0)
            for a, a_from, a_until in self._edge(left, 1):
                for b, b_from, b_until in starts:
                    if a_from < b_until and b_from < a_until:
                        rank = self.ranks.get(a + b)
                        if rank is not None and rank < a_until and rank <= b_until:
                            ok = False
                            break
                if not ok:
                    break
            self.pairs[key] = ok
        return ok

    def _move(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        here, still, child, at, leaf, parts, pairs = None, [], self.child, self.at, self.leaf, self.parts, self.pairs
        for node, path in state.open:
            grown = child.get(node << 8 | byte)
            if grown is None:
                continue
            token = at[grown]
            if here is None and token >= 0 and (parts[token] if token in parts else self._last_merge(token)) != ():
                left = path[-1] if path else state.last
                ok = left < 0 or pairs.get(left << 32 | token)
                if ok or ok is None and self._may_follow(left, token):
                    here = (*path, token)
            if not leaf[grown]:
                still.append((grown, path))
        if here is None:
            raise ValueError(f"no token ends with byte {byte}; the vocabulary lacks single bytes")
        sure = len(here)
        for _, p in still:
            sure = min(sure, len(p))
            while p[:sure] != here[:sure]:
                sure -= 1
        emitted = here[:sure]
        still.append((0, here))
        open_ = tuple([(n, p[sure:]) for n, p in still]) if sure else tuple(still)
        move = self._state(emitted[-1] if emitted else state.last, open_), emitted
        state.moves[byte] = move
        return move

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.clear()
        state, out = self.start, []
        for byte in piece:
            move = state.moves.get(byte)
            if move is None:
                move = self._move(state, byte)
                if len(self.states) > self.max_states + 100_000:  # one very long piece
                    keep = move[0]
                    self.clear()
                    move = self._state(keep.last, keep.open), move[1]
            state, emitted = move
            if emitted:
                out += emitted
        out += state.open[-1][1]
        return out


class Pieces(dict):
    """Ids of pieces as little-endian 32-bit integers; a missing piece is encoded."""

    def __init__(self, ranks: dict[bytes, int], max_states: int, max_pieces: int) -> None:
        self.transducer, self.max_pieces = Transducer(ranks, max_states), max_pieces

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.max_pieces:
            self.clear()
        ids = np.array(self.transducer.encode(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, raw: bytes, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> None:
        ranks = parse_ranks(raw)
        self.pieces, self.findall = Pieces(ranks, max_states, max_pieces), split_pattern(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.findall(text)))

    def decode(self, ids: bytes, block: int = 1 << 16) -> Iterator[str]:
        """Text of the ids, block by block; a character cut by a block's end waits for the next."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        values = np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(values), block):
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, values[at : at + block].tolist())))
        yield machine.decode(b"", final=True)


_codecs: dict[tuple, Codec] = {}


def codec(raw: bytes, pattern: str, *limits: int) -> Codec:
    """The codec of a worker process; another vocabulary or limit takes its place."""
    key = hash(raw), pattern, limits
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern, *limits)
    return _codecs[key]


def _rows(shared, pattern: str, limits: tuple[int, int], keep: bool, batches: Iterator[pa.RecordBatch],
          with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = codec(shared.value, pattern, *limits)
    gc.disable()  # it would walk through all states again and again; they are let go in ``clear``
    for batch in batches:
        n, sha, back, ids = [], [], [], []
        for text in batch.column(0):
            coded = own.encode(text.as_py() or "")
            digest = hashlib.sha256()
            for part in own.decode(coded):
                digest.update(part.encode())
            n.append(len(coded) // 4)
            sha.append(hashlib.sha256(coded).hexdigest())
            back.append(digest.hexdigest())
            if with_ids:
                ids.append(coded)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()),
             *([pa.array(ids, pa.binary())] if with_ids else [])],
            [*batch.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])
    if not keep:
        own.pieces.clear()
        own.pieces.transducer.clear()


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", with_ids: bool = True,
           max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES, keep: bool = True) -> DataFrame:
    """``docs`` without the text, plus n_tokens, digests of the ids and of the decoded text, and ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers. Null and empty texts have no
    tokens. Columns of ``docs`` with the new columns' names are replaced. ``vocabulary``
    is a local path on the driver. The limits bound a worker's memory: about 1 KB for each
    state and 0.2 KB for each piece; they don't change results. With ``keep`` a worker keeps
    them for its next task.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    new = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    wide = docs.select(F.col(text_col).cast("string").alias("_text"), *[c for c in docs.columns if c != text_col and c not in new])
    schema = wide.drop("_text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", "binary")
    return wide.mapInArrow(lambda it: tidied(_rows(shared, pattern, (max_states, max_pieces), keep, it, with_ids)), schema)


def _decoded(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(shared.value, "")
    for batch in batches:
        texts = ["".join(own.decode(ids.as_py() or b"")) for ids in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])


def decode(coded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` without the ids, plus ``text``; null ids give an empty text."""
    with open(vocabulary, "rb") as f:
        shared = coded.sparkSession.sparkContext.broadcast(f.read())
    wide = coded.select(F.col(ids_col).alias("_ids"), *[c for c in coded.columns if c not in (ids_col, "text")])
    return wide.mapInArrow(lambda it: tidied(_decoded(shared, it)), wide.drop("_ids").schema.add("text", "string"))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
