"""Byte-level BPE encoding and decoding with the tokenizers library.

``Encoder`` encodes whole texts. A text is cut at each single space that follows a character other
than white space: the pre-token pattern always starts a pre-token there, so pieces can be encoded
apart. The library's merge model encodes each distinct pre-token once; a bounded memo of two
generations keeps the ids.
Vocabulary files are named by path and are never copied.
"""

from __future__ import annotations

import base64
import functools
import re
import struct

import numpy as np

#: Pieces whose ids a worker keeps, and the longest piece that is kept. Memory only: results don't depend on them.
MEMO_PIECES, MEMO_CHARS = 400_000, 64

_SAFE_CUT = re.compile(r"(?<=\S) ")
_SPACES_RUN = re.compile(r"\s ")


def byte_to_char() -> dict[int, str]:
    """The byte table of byte-level BPE: printable bytes stand for themselves, others for code points from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token of two bytes or more, in rank order.

    It is the pair that is left when the token's bytes are merged by all lower ranks.
    """
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        if len(token) < 2:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            at, best = None, rank
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    at, best = i, r
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


def tokenizer_from_ranks(path: str, pattern: str):
    """A tokenizer that merges by the ranks in ``path`` within each match of ``pattern``."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, shown = read_ranks(path), byte_to_char()
    spell = lambda token: "".join(map(shown.__getitem__, token))
    vocab = {spell(token): rank for token, rank in ranks.items()}
    merges = [(spell(a), spell(b)) for a, b in merges_of(ranks)]
    made = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    made.decoder = decoders.ByteLevel()
    return made


def tokenizer_from_json(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Memo(dict):
    """Ids of pieces, filled on demand; a second generation takes over when the first is full."""

    def __init__(self, make):
        self.make, self.old, self.most = make, {}, MEMO_PIECES

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.old = {}
        self.clear()


class Encoder:
    """Encodes by a tokenizer's merge model, within each match of ``pattern``.

    Strings of the tokenizer's added tokens are tokens of their own, as in the library: a text that has
    one is encoded by the library as a whole.
    """

    def __init__(self, tokenizer, pattern: str):
        import regex

        self.tokenizer, self.model, self.pre_tokens = tokenizer, tokenizer.model, regex.compile(pattern).findall
        shown = byte_to_char()
        self.shown = {b: ord(c) for b, c in shown.items()}
        self.space = shown[ord(" ")]
        chars = {c: b for b, c in shown.items()}
        added = tokenizer.get_added_tokens_decoder()
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values())).search if added else None
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        names = {i: t.content for i, t in added.items()}
        self.token_bytes: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            spelt = i not in names and all(c in chars for c in token)
            self.token_bytes[i] = bytes(chars[c] for c in token) if spelt else names.get(i, token).encode()
        self.id_bytes = [struct.pack("<I", i) for i in range(len(self.token_bytes))]
        #: Pre-tokens, and words with the space before them left out.
        self.pre, self.words = _Memo(self._encode_pre_token), _Memo(self._encode_word)
        self.marks = {mark: self.pre[mark] for mark in ".,;:!?"}

    def _encode_pre_token(self, pre: str) -> bytes:
        if pre.isascii() and pre.isprintable():  # all but the space are spelt as they are
            spelt = pre.replace(" ", self.space)
        else:
            spelt = pre.encode().decode("latin-1").translate(self.shown)
        of = self.id_bytes
        return b"".join([of[t.id] for t in self.model.tokenize(spelt)])

    def _encode_word(self, word: str) -> bytes:
        """The ids of a space and ``word``, which has no white space that could join the space before it."""
        if word.isalpha():  # one pre-token
            return self._encode_pre_token(" " + word)
        stem, mark = word[:-1], word[-1:]
        if mark in self.marks and stem.isalpha():  # two pre-tokens, of which the first is shared with the bare word
            return self.words[stem] + self.marks[mark]
        return self._encode_piece(" " + word)

    def _encode_piece(self, piece: str) -> bytes:
        words, pre = self.words, self.pre
        return b"".join([words[x[1:]] if x[0] == " " and x[1:].isalpha() else pre[x] for x in self.pre_tokens(piece)])

    def _encode_text(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added is not None and self.added(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _SAFE_CUT.split(text) if _SPACES_RUN.search(text) else text.split(" ")
        # all parts but the first begin with their space, which is put back when a part is encoded
        return self._encode_piece(parts[0]) + b"".join(map(self.words.__getitem__, parts[1:]))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            out.append(self._encode_text(text))
            self.words.turn()
            self.pre.turn()
        return out

    def keep(self, pieces: int) -> None:
        """From now on each generation of a memo has about so many pieces at most."""
        self.words.most = self.pre.most = pieces

    def forget(self) -> None:
        """Drop the memos: a worker that Spark keeps for later tasks then holds the vocabulary only."""
        self.words.forget()
        self.pre.forget()

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> list[tuple[int, int]]:
        """For each token, the characters (start, end) that its bytes touch.

        A character whose bytes are split between tokens belongs to each of them.
        """
        tokens = [self.token_bytes[i] for i in np.frombuffer(ids, "<u4").tolist()]
        data = np.frombuffer(b"".join(tokens), np.uint8)
        begins = (data & 0xC0) != 0x80
        # chars[i]: the character that byte i belongs to
        chars = np.cumsum(begins) - 1
        ends = np.cumsum([len(t) for t in tokens])
        starts = ends - np.array([len(t) for t in tokens], dtype=np.int64)
        return [(int(chars[s]), int(chars[e - 1]) + 1) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


class StreamDecoder:
    """Decodes ids chunk by chunk; bytes of a character split between chunks wait for the rest."""

    def __init__(self, encoder: Encoder):
        import codecs

        self.encoder, self.text = encoder, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes, final: bool = False) -> str:
        return self.text.decode(self.encoder.decode_bytes(ids), final)


@functools.lru_cache(maxsize=4)
def encoder_for(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary file (``.tiktoken`` ranks or a tokenizers JSON) and its pre-token pattern."""
    return Encoder(tokenizer_from_ranks(path, pattern) if path.endswith(".tiktoken") else tokenizer_from_json(path), pattern)
