"""Exact, cached byte-level BPE encoding inside a task.

A text is cut at its single spaces: each piece with its leading space is a whole
number of pre-tokens, because the pre-tokenizer joins at most one space to what
follows and never to what precedes. Pieces repeat, so a batch is cut and
dictionary-encoded column-wise, and only pieces not met before go through the tokenizer's
own pre-tokenizer and model. Texts where a cut would touch other white space are
encoded whole, and so are texts that hold the string of an added token which is to get
its own id. The ids equal those of encoding every text whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from peakscreen.llm.common import strings

#: Pre-tokens remembered by a worker; beyond it the memory starts anew.
CACHE = 600_000
#: Bytes of text cut at a time.
_BYTES = 16 << 20
#: Punctuation that forms one pre-token with its like (the apostrophe may open a contraction).
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()


def load(tokenizer_json: str, control_ids: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one task, one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    t.encode_special_tokens = not control_ids     # or else control strings in a text are ordinary text
    t.no_padding()
    t.no_truncation()
    return t


class Encoder:
    """Encodes batches of texts to uint32 ids; safe for any text and any byte-level BPE file.

    With ``control_ids``, control strings in a text (such as an end-of-text mark) get the ids of
    the file's special tokens, as the library does unless told otherwise; without, they are ordinary text.
    """

    def __init__(self, tokenizer_json: str, control_ids: bool = False):
        self.tokenizer = load(tokenizer_json, control_ids)
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.by_piece = kind == "ByteLevel" and self.tokenizer.normalizer is None \
            and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.words: dict[str, bytes] = {}
        # The model alone does not look for added tokens.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if control_ids or not t.special]
        self.added = "|".join(re.escape(c) for c in added)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _word(self, word: str) -> bytes:
        """Ids of a pre-token in the byte-level alphabet."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            found = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()
        return found

    def _simple(self, lead: str, part: str) -> bytes | None:
        """Ids of Latin letters with punctuation behind (either may be missing), else None."""
        core = part.rstrip(_TAIL)
        tail = part[len(core):]
        if not core:
            return self._word(lead + tail)
        if not core.isalpha():
            return None
        if not core.isascii():
            if max(core) > "\xff":
                return None
            core = core.encode().decode("latin-1").translate(_ALPHABET)
        return self._word(lead + core) + self._word(tail) if tail else self._word(lead + core)

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a piece with its leading space; None if cutting there is not safe."""
        if piece.isascii() and piece.isalpha():
            return self.words.get("Ġ" + piece) or self._word("Ġ" + piece)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        ids = self._simple("Ġ", piece)
        if ids is None and "\n" in piece and "\n\n" not in piece:
            first, *rest = piece.split("\n")
            lines = [self._simple("Ġ", first), *(self._simple("", x) for x in rest)]
            if None not in lines:
                return self._word("Ċ").join(lines)
        if ids is None:
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str(" " + piece)
            return b"".join([self._word(w) for w, _ in split])
        return ids

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text (one more than texts). Null: empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        flats, sizes = [], []
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _BYTES, "right")))
            flat, size = self._rows(texts.slice(lo, hi - lo))
            flats.append(flat)
            sizes.append(size)
            lo = hi
        if not flats:
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        return np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_piece:
            rows = [self.whole(t) for t in texts.to_pylist()]
            return np.concatenate(rows), np.array([len(r) for r in rows])
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy()
        starts, ends = starts[:-1] - starts[0], starts[1:] - starts[0]
        coded = cut.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        distinct = strings(coded.dictionary)
        ids = [self._piece(p) for p in distinct]
        # A text's first piece has no leading space.
        head_of: dict[int, int] = {}
        heads = index[starts]
        for i in dict.fromkeys(heads.tolist()):
            piece = distinct[i]
            head_of[i] = len(ids)
            ids.append(None if piece[-1:].isspace() else self.whole(piece).tobytes() if piece else b"")
        index[starts] = [head_of[i] for i in heads.tolist()]
        size = np.array([0 if i is None else len(i) // 4 for i in ids], dtype=np.int64)
        per_text = np.add.reduceat(size[index], starts)
        bad = np.array([distinct[i] == "" for i in heads.tolist()]) & (ends - starts > 1)
        if None in ids:
            bad |= np.logical_or.reduceat(np.array([i is None for i in ids])[index], starts)
            ids = [i or b"" for i in ids]
        if self.added:
            bad |= pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
        flat = np.frombuffer(b"".join(map(ids.__getitem__, index.tolist())), dtype=np.uint32)
        if bad.any():
            cuts = np.concatenate([[0], np.cumsum(per_text)])
            rows = [self.whole(texts[r].as_py()) if bad[r] else flat[cuts[r]:cuts[r + 1]]
                    for r in range(len(texts))]
            flat, per_text = np.concatenate(rows), np.array([len(r) for r in rows])
        return flat, per_text


_LOADED: dict[tuple[int, bool], Encoder] = {}


def encoder(tokenizer_json: str, control_ids: bool = False) -> Encoder:
    """This worker's encoder of a tokenizer file (kept between tasks)."""
    key = hash(tokenizer_json), control_ids
    if key not in _LOADED:
        _LOADED[key] = Encoder(tokenizer_json, control_ids)
    return _LOADED[key]
