"""Token ids of whole texts by the tokenizers library, encoding each repeated piece once.

Encoding is the costly step, and texts repeat their words. Where a tokenizer never lets a
token cross a blank, a text's ids are those of its pieces between blanks, so pieces are
counted by Arrow, only new ones are encoded, and ids are gathered with numpy:

* `pieces="word"`: white space is dropped and never inside a token; letters are lower-cased.
* `pieces="blank"`: a blank belongs to the piece after it. Texts with two white-space
  characters in a row are encoded whole, as the split inside such a run looks ahead.
* `pieces="whole"`: no such rule is known; every text is encoded whole.

A piece also ends between an ASCII letter or digit and a sign of `TAIL`, since no token of these tokenizers
crosses from the one to the other. The added tokens of a tokenizer file (such as `<|endoftext|>`) follow none of
these rules: texts that hold the content of one are encoded whole.

New pieces that begin with a blank and end in no white space are encoded many at once, as one text: there
each blank begins a piece, so a piece begins at each token that begins with a blank.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagelens.llm.words import LOWERED, ragged_take, string_array, text_bytes

#: Encoded pieces a worker remembers at most: beyond half of it, it forgets those not met since the half before.
REMEMBERED = 400_000
#: Pieces encoded as one text.
AT_ONCE = 2_000
TAIL = ".,;:!?%$#*&|"
TWO_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}][\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TAIL_BYTES = np.isin(np.arange(256), list(TAIL.encode()))
PLAIN_BYTES = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
WHITE_BYTES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(model: str, pieces: str) -> Encoder:
    """This worker's encoder for the tokenizer file content `model`."""
    key = (hash(model), pieces)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model, pieces)
    return _encoders[key]


class Encoder:
    def __init__(self, model: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        if pieces not in ("word", "blank", "whole"):
            raise ValueError(f"pieces must be word, blank or whole, not {pieces!r}")
        self.tokenizer = Tokenizer.from_str(model)
        added = [t for t in json.loads(model).get("added_tokens") or [] if t["content"]]
        if self.tokenizer.normalizer is not None and any(t.get("normalized") for t in added):
            pieces = "whole"  # such a token is looked for in the normalized text
        self.pieces = pieces
        # Texts to encode whole. Pieces may be lower-cased, so the case of an added token does not matter here.
        odd = [TWO_BLANKS] if pieces == "blank" else []
        odd += [f"(?i:{re.escape(t['content'])})" for t in added]
        self.odd = "|".join(odd)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        blank = "\u0120"  # how byte-level vocabularies write a blank
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(blank)]] = True

    def _at_once(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that each begin with a blank and hold no other, and end in no white space."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(pieces) or first[0] != 0:
            return self._whole(pieces)
        raw, at = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        joint, alone = [], new
        if self.pieces == "blank":
            joint = [p for p in new if p[0] == " " and not p[-1].isspace()]
            alone = [p for p in new if p[0] != " " or p[-1].isspace()]
        for at in range(0, len(joint), AT_ONCE):
            part = joint[at : at + AT_ONCE]
            self.known.update(zip(part, self._at_once(part)))
        for at in range(0, len(alone), 10_000):
            part = alone[at : at + 10_000]
            self.known.update(zip(part, self._whole(part)))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        out = list(map(self.known.get, pieces))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missing:
            ids = self.older.get(pieces[i])
            if ids is None:
                new.append(pieces[i])
            else:
                self.known[pieces[i]] = ids
        self._learn(new)
        for i in missing:
            out[i] = self.known[pieces[i]]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]; nulls are empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        if self.pieces == "whole":
            return self._joined(self._whole(texts.to_pylist()))
        odd = np.zeros(len(texts), dtype=bool)
        if self.odd:
            odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if odd.any():
            even, even_offsets = self._even(texts.filter(pa.array(~odd)))
            whole, whole_offsets = self._joined(self._whole(texts.filter(pa.array(odd)).to_pylist()))
            ids = np.concatenate([even, whole])
            starts, lengths = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
            starts[~odd], lengths[~odd] = even_offsets[:-1], np.diff(even_offsets)
            starts[odd], lengths[odd] = whole_offsets[:-1] + len(even), np.diff(whole_offsets)
            return ragged_take(ids, starts, lengths, np.arange(len(texts))), np.concatenate([[0], np.cumsum(lengths)])
        return self._even(texts)

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = text_bytes(texts)
        data = LOWERED[raw] if self.pieces == "word" else raw
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        # A piece begins at each blank, at a tail and at each text.
        begins = (WHITE_BYTES[raw] if self.pieces == "word" else raw == 32).copy()
        begins[1:] |= TAIL_BYTES[raw[1:]] & PLAIN_BYTES[raw[:-1]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        coded = string_array(data, np.append(starts, len(data))).dictionary_encode()
        ids, id_offsets = self._joined(self._pieces(coded.dictionary.to_pylist()))
        chosen = coded.indices.to_numpy()
        lengths = np.diff(id_offsets)
        ends = np.concatenate([[0], np.cumsum(lengths[chosen])])
        return ragged_take(ids, id_offsets[:-1], lengths, chosen), ends[np.searchsorted(starts, offsets)]

    @staticmethod
    def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        return np.frombuffer(b"".join(parts), dtype="<u4"), np.concatenate([[0], np.cumsum(sizes)])


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids with the end id after them."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))


def read_model(path: str) -> str:
    """The tokenizer file's content, read once by the driver and sent along: a few megabytes."""
    with open(path, encoding="utf-8") as f:
        return f.read()
