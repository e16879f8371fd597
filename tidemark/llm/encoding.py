"""Token ids of whole texts by a public byte-level BPE vocabulary.

The distinct words of a batch are put, in order, into a trie of bytes. Each trie node keeps
the last token of the encoding of its prefix and the node where that token begins, so the
encoding of a prefix that many words share is worked out once, and the encoding of a word is
read off by following these links. The last token of a prefix is the one token that ends
there, whose beginning is a prefix that may be followed by it: two tokens may follow each
other if no merge of their parts would come before the merges inside them. That choice is
unique, so no word is ever merged from its bytes.

Texts never leave their partition: there is no shuffle, and the driver sees no text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import ship

#: White space as Unicode defines it, which is what the vocabulary's word pattern means by it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the published word pattern of this family of vocabularies.
WORDS = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A single space between two visible characters always begins a word, so texts may be cut there.
CUT = re.compile(r"(?<=\S)(?= \S)")
RUN = re.compile(r" \s|\s ")
#: Bounds of what a worker keeps: trie nodes, cached pieces, the size of a piece worth keeping, and pairs of tokens (together some 200 MB).
NODES, PIECES, PIECE_CHARS, PAIRS = 600_000, 300_000, 48, 500_000
#: Longer words do not enter the trie.
WORD_BYTES = 256
#: Characters encoded in one go.
GO = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes words of one vocabulary file (the ``tokenizers`` JSON with its vocabulary and merges)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = byte_alphabet()
        ids = model["vocab"]
        spelled = {t: bytes(map(back.__getitem__, t)) for t in ids if all(c in back for c in t)}
        self.tokens = {b: ids[t] for t, b in spelled.items()}
        self.length = {i: len(b) for b, i in self.tokens.items()}
        #: Everything a token can end with: tells how far back a token that ends here may begin.
        self.endings = {b[k:] for b in self.tokens for k in range(len(b))}
        #: Order of the merge of two tokens, and of each token its last merge: order, left and right part.
        self.order: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = (ids[a], ids[b])
            self.order[pair] = n
            self.made.setdefault(ids[a + b], (n, *pair))
        self.follows: dict[int, bool] = {}  # by left * 2^32 + right
        self.clear()

    def clear(self) -> None:
        """Forget all words; results do not depend on what is kept."""
        self.child: dict[int, int] = {}  # by node * 256 + byte
        self.last = array("i", [-1])  # the last token of the prefix at this node
        self.start = array("i", [0])  # the node where that token begins
        self.head: dict[str, bytes] = Pieces(self, "")
        self.tail: dict[str, bytes] = Pieces(self, " ")

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends in just these two.

        Both are taken apart from the outside in, latest merge first. Whenever the parts that
        touch have a merge of their own, it must not come before the merge that next used up
        one of them, else it would have happened.
        """
        known = self.follows.get(left << 32 | right)
        if known is not None:
            return known
        a, b, ok = left, right, True
        # The merges that will next consume a (as right end of something) and b (as left end).
        bound_a = bound_b = 1 << 60
        while True:
            n = self.order.get((a, b))
            # On a tie of order the leftmost pair goes first: a's own consumer lies to the left.
            if n is not None and n < bound_a and n <= bound_b:
                ok = False
                break
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                break
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                bound_a, a = made_a[0], made_a[2]
            elif made_a is None or made_b[0] > made_a[0]:
                bound_b, b = made_b[0], made_b[1]
            else:  # the same merge on both sides: the left one happens first, so its parts are the older state
                bound_b, b = made_b[0], made_b[1]
        if len(self.follows) > PAIRS:
            self.follows.clear()
        self.follows[left << 32 | right] = ok
        return ok

    def insert(self, word: bytes) -> int:
        """The node of a word; nodes and their states are made for the part that no word before shared."""
        child, last, start = self.child, self.last, self.start
        node, path = 0, [0]
        for i, byte in enumerate(word, 1):
            following = child.get(node << 8 | byte)
            if following is None:
                following = child[node << 8 | byte] = len(last)
                at, token = self.final(word, i, lambda k: last[path[k]])
                last.append(token)
                start.append(path[at])
            node = following
            path.append(node)
        return node

    def final(self, word: bytes, i: int, before: Callable[[int], int]) -> tuple[int, int]:
        """Begin and number of the last token of the first i bytes; ``before`` gives the last token of a shorter prefix (-1: none)."""
        tokens, endings, found = self.tokens, self.endings, []
        at = i - 1
        while at >= 0 and (piece := word[at:i]) in endings:
            token = tokens.get(piece)
            if token is not None:
                found.append((at, token))
            at -= 1
        for at, token in reversed(found):
            left = before(at)
            if (left < 0 or self.may_follow(left, token)) and self.whole(token):
                return at, token
        raise ValueError(f"the vocabulary has no encoding of {word[max(0, i - 40) : i]!r}")

    def long_ids(self, word: bytes) -> list[int]:
        """The ids of a word too long to keep: the states of its own prefixes, in two plain arrays, forgotten afterwards."""
        last, start = array("i", [-1]), array("i", [0])
        for i in range(1, len(word) + 1):
            at, token = self.final(word, i, last.__getitem__)
            last.append(token)
            start.append(at)
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i = start[i]
        return out[::-1]

    @lru_cache(maxsize=None)  # noqa: B019 - one encoder per worker
    def whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes: its two parts meet before anything across them."""
        made = self.made.get(token)
        if made is None:
            return self.length[token] == 1
        return self.whole(made[1]) and self.whole(made[2]) and self._joins(made)

    def _joins(self, made: tuple[int, int, int]) -> bool:
        """Whether the two parts of a merge stand side by side before it: no merge across them comes earlier."""
        n, a, b = made
        bound_a = bound_b = 1 << 60
        first = True
        while True:
            m = self.order.get((a, b))
            if not first and m is not None and m < bound_a and m <= bound_b:
                return False
            first = False
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                bound_a, a = made_a[0], made_a[2]
            else:
                bound_b, b = made_b[0], made_b[1]

    def ids(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.last[node])
            node = self.start[node]
        return out[::-1]

    def learn(self, pieces: dict[str, bytes], texts: set[str]) -> None:
        """Cache the encodings of pieces: their distinct words go into the trie in byte order, that is depth first."""
        found = {t: [w.encode("utf-8", "replace") for w in WORDS.findall(pieces.prefix + t)] for t in texts}
        encoded: dict[bytes, bytes] = {}
        for w in sorted(set(chain.from_iterable(found.values()))):
            encoded[w] = array("i", self.ids(self.insert(w)) if len(w) <= WORD_BYTES else self.long_ids(w)).tobytes()
        for t, words in found.items():
            dict.__setitem__(pieces, t, b"".join([encoded[w] for w in words]))

    def encode(self, texts: list[str | None]) -> tuple[array, bytes]:
        """Ends (in ids, beginning with 0) and the ids of all texts, as 32-bit integers."""
        ends, total, whole = array("i", [0]), 0, []
        for group in _groups(texts):
            if len(self.last) > NODES or len(self.head) + len(self.tail) > PIECES:
                self.clear()
            cut = [_pieces(t) for t in group]
            new = set(chain.from_iterable(p[1] for p in cut)).difference(self.tail)
            self.learn(self.tail, {t for t in new if len(t) <= PIECE_CHARS})
            for head, rest in cut:
                ids = b"".join((self.head[head], *map(self.tail.__getitem__, rest)))
                whole.append(ids)
                total += len(ids) // 4
                ends.append(total)
        return ends, b"".join(whole)


class Pieces(dict):
    """Encodings of pieces of text after a prefix; a long piece is encoded when asked for and not kept."""

    def __init__(self, encoder: Encoder, prefix: str) -> None:
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, piece: str) -> bytes:
        if not piece and not self.prefix:
            return b""
        self.encoder.learn(self, {piece})
        return self[piece] if len(piece) <= PIECE_CHARS else self.pop(piece)


def _pieces(text: str | None) -> tuple[str, list[str]]:
    """The first piece, and the further ones without the space that each begins with."""
    if not text:
        return "", []
    if RUN.search(text):
        parts = CUT.split(text)
        return parts[0], [p[1:] for p in parts[1:]]
    head, *rest = text.split(" ")
    return head, rest


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > GO:
            yield group
            group, size = [], 0
    if group:
        yield group


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once per worker."""
    return Encoder(path)


def encode_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row, without special tokens.

    A null or empty text gives an empty list. Strings that look like special tokens are
    ordinary text. Texts are encoded whole, repeated rows each on their own. ``path`` is the
    vocabulary file, readable on every executor.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ends, ids = own.encode(batch.column(1).to_pylist())
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["__id", "ids"])

    rows = docs.select(docs[doc_id].alias("__id"), docs[text].alias("__text"))
    return rows.mapInArrow(encode, f"__id {kind}, ids array<int>").withColumnRenamed("__id", doc_id)
