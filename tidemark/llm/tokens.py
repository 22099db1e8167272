"""Token counts and ids of whole texts, by public tokenizers, in Arrow functions.

A text is cut at boundaries that provably do not change its tokens, distinct pieces that a worker has
not met are encoded in one batch of the library, and pieces met before come from a bounded memo. The
tokens of the pieces, joined, are exactly those of the whole text.
"""

from __future__ import annotations

import os
import re
import string
from array import array

import pyarrow as pa

#: Pieces that a worker remembers at most, unless told otherwise; others are encoded but not remembered.
MEMO = 300_000
#: Texts are handled in groups of about so many bytes, whatever the number of rows of a batch, and
#: pieces go to the library in batches of about so many.
GROUP_BYTES = 2_000_000
BATCH_BYTES = 1 << 20
_ASCII_OPEN = frozenset(string.punctuation)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters whose composed form is canonical and whose lower case is one letter: ASCII and Latin-1.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII punctuation but the apostrophe, which pre-token patterns treat apart.
_MARKS = "".join(c for c in string.punctuation if c != "'")
_SIMPLE = re.compile(f"( ?)([{_LETTER}]+)([{re.escape(_MARKS)}]*)")


def _byte_alphabet() -> dict[int, str]:
    """The characters by which byte-level models write bytes: printable Latin-1 as itself, the others
    by the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


class PieceEncoder:
    """Encodes texts piece by piece. `value` maps a list of ids to what is kept for it.

    style "byte": byte-level pre-tokens may begin with one space, so the text is cut before a single
    space that a letter, digit or ASCII punctuation mark follows; the pre-token pattern always starts
    a new token there, and what stands before sees white space next or its own end, alike.
    style "word": white space only separates and is dropped, so every space or line end is a cut.
    A text that holds a special token's string is encoded whole.

    A new piece that is letters, then marks (and, style "byte", more such after single line ends)
    has obvious pre-tokens, which go to the library's model directly; other new pieces go through the
    whole library, in one batch.
    """

    def __init__(self, path: str, style: str, value, join, room: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte = style == "byte"
        self.cut = self._byte if self.byte else self._word
        self.value, self.join, self.memo, self.known, self.room = value, join, {}, {}, room
        self.alphabet = _byte_alphabet()
        self.line = self._pretoken("\n") if self.byte else None

    def _byte(self, text: str) -> list[str]:
        first, *rest = text.split(" ")
        out = [first] if first else []
        for p in rest:
            if p and (p[0] in _ASCII_OPEN or p[0].isalpha() or p[0].isdigit()):
                out.append(" " + p)
            elif out:
                out[-1] += " " + p
            else:
                out.append(" " + p)
        return out

    def _word(self, text: str) -> list[str]:
        return [p for p in text.replace("\n", " ").split(" ") if p]

    def pieces(self, text: str) -> list[str]:
        return [text] if any(s in text for s in self.special) else self.cut(text)

    def _pretoken(self, t: str):
        got = self.known.get(t)
        if got is None:
            seen = t if t.isascii() and t.isalpha() else "".join(map(self.alphabet.__getitem__, t.encode()))
            got = self.value([x.id for x in self.model.tokenize(seen)])
            if len(self.known) < self.room:
                self.known[t] = got
        return got

    def _simple(self, piece: str):
        """The value of a piece of obvious pre-tokens, else None."""
        if not self.byte:
            word = piece.rstrip(_MARKS)
            if word.isascii() and word.isalpha():
                got = self._pretoken(word.lower())
                return got if len(word) == len(piece) else self.join((got, self._pretoken(piece[len(word) :])))
        out = []
        for k, part in enumerate(piece.split("\n") if self.byte else (piece,)):
            m = _SIMPLE.fullmatch(part)
            if not m or (k and m[1]):
                return None
            if k:
                out.append(self.line)
            out.append(self._pretoken(m[1] + m[2] if self.byte else m[2].lower()))
            if m[3]:
                out.append(self._pretoken(m[3]))
        return self.join(out)

    def _new(self, pieces) -> dict:
        """The values of the pieces that the memo does not have."""
        memo, fresh, hard = self.memo, {}, []
        for p in pieces:
            if p not in memo:
                fresh[p] = got = self._simple(p)
                if got is None:
                    hard.append(p)
        # batches of about equal bytes, a longer piece by itself
        sizes = [len(p.encode()) for p in hard]
        start = 0
        while start < len(hard):
            stop, size = start + 1, sizes[start]
            while stop < len(hard) and size + sizes[stop] <= BATCH_BYTES:
                size += sizes[stop]
                stop += 1
            part, start = hard[start:stop], stop
            fresh.update(zip(part, (self.value(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        return fresh

    def values(self, pieces, use):
        """use(the memo with the values of all pieces); the memo then forgets what it has no room for."""
        fresh = self._new(pieces)
        room = self.room - len(self.memo)
        self.memo.update(fresh)
        out = use(self.memo.__getitem__)
        if len(fresh) > room:
            for p in list(fresh)[max(room, 0) :]:
                del self.memo[p]
        return out

    def encode(self, texts: list[str]) -> list:
        cut = [self.pieces(t) for t in texts]
        return self.values(set().union(*cut), lambda get: [self.join(map(get, ps)) for ps in cut])

    def word_ids(self, texts: pa.Array) -> tuple:
        """Style "word": the ids of all texts in one array, and the offsets of the texts in it. Arrow
        cuts and numbers the words, so that Python sees each distinct word once."""
        import numpy as np
        import pyarrow.compute as pc

        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        got = self.values((w for w in distinct if w), lambda get: [get(w) if w else b"" for w in distinct])
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), "<u4")
        first = np.cumsum(size) - size
        index = words.indices.to_numpy(zero_copy_only=False)
        n = size[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bounds = np.concatenate([[0], ends])[at]
        if odd.any():
            parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            for k in np.flatnonzero(odd).tolist():
                parts[k] = np.frombuffer(self.encode([texts[k].as_py()])[0], "<u4")
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts) if parts else ids
        return ids, bounds


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, style: str, kind: str, memo: int = MEMO) -> PieceEncoder:
    """One encoder for each worker process, file and kind ("length" or "ids")."""
    key = (path, style, kind, memo)
    if key not in _encoders:
        if kind == "length":
            _encoders[key] = PieceEncoder(path, style, len, sum, memo)
        else:
            _encoders[key] = PieceEncoder(path, style, lambda ids: array("I", ids).tobytes(), b"".join, memo)
    return _encoders[key]


def slices(texts: pa.Array, size: int = 8_000_000):
    """Consecutive slices of an Arrow array of about `size` bytes, so that memory follows bytes, not rows."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else []
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = min(len(texts), int(np.searchsorted(ends, base + size)) + 1)
        yield start, stop
        start = stop


def token_counts(docs, tokenizer: str = "byte_bpe_50k.json", style: str = "byte", limit: int = 512, id_col: str = "doc_id", text_col: str = "text"):
    """(id, n_bytes, n_tokens, over_limit) for each row; null text counts as empty, repeated rows and
    null ids stay as they are, other columns are ignored, an empty table gives an empty result. A very
    long text is cut into pieces at safe boundaries; a piece without any goes to the library whole, and so
    does a text with a special token's string. Only lengths leave the Arrow function."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType
    out = StructType([StructField(id_col, kind), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def count(batches):
        import pyarrow.compute as pc

        enc = encoder(public_path(tokenizer), style, "length")
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            n = []
            for lo, hi in slices(texts, GROUP_BYTES):
                n += enc.encode(texts.slice(lo, hi - lo).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, out)
