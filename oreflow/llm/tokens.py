"""Token ids of whole texts through the tokenizers library, with the words that recur encoded once.

A text is cut where its tokenizer cuts it anyway, the ids of each part are looked up, and the parts
that are new are encoded by the library together.  Memory is bounded by entries and bytes: see Parts.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from struct import pack


#: Parts of a generation; the older of two generations is forgotten when the younger is full.
CACHE_PARTS = 400_000
#: What an entry of usual length takes, and the length from which a part is not remembered.
ENTRY_BYTES = 240
LONG = 256

#: White space outside ASCII, in UTF-8.
_WIDE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
#: A blank that starts no word: more white space or the end follows.
_LOOSE = re.compile(rb" (?:[ \t\n\r\x0b\x0c]|\Z|" + _WIDE + rb")")
_FIRM = re.compile(rb" (?![ \t\n\r\x0b\x0c]|\Z|" + _WIDE + rb")")

_BORDER = "\0"
#: What words that are encoded as one text must not hold: other white space, and the border.
_ODD = re.compile(rb"[\t\n\r\x0b\x0c\0]|" + _WIDE)
#: A comma or full stop before a blank that may belong to more signs before it; letters up to U+00FF and digits end a word.
_BOUND = re.compile(rb"[.,](?<![0-9A-Za-z][.,])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][.,]) ")
#: Bytes that no UTF-8 text has stand for a comma and a full stop behind a word.
_COMMA, _STOP = b"\xfe", b"\xff"
#: Words of letters up to U+00FF, which a byte-level tokenizer leaves whole, and its characters for their bytes.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_CHARACTERS = {x: 256 + 33 + x - 127 for x in range(127, 161)} | {173: 256 + 67}
#: Two ASCII characters that are no white space.
_SOLID = re.compile(rb"[!-~]{2}")


class Parts:
    """Two generations of remembered parts, bounded by entries and by bytes: about 2 * size * ENTRY_BYTES in all.

    Parts longer than LONG are made anew each time, so texts without blanks are not kept.
    """

    def __init__(self, size: int = CACHE_PARTS) -> None:
        self.size, self.young, self.old, self.held = size, {}, {}, 0

    def values(self, parts: list, make) -> list:
        """The value of each part; make(list) gives the values of new ones."""
        found = list(map(self.young.get, parts))
        if None in found:
            young, old, long = self.young, self.old, {}
            gaps = [n for n, v in enumerate(found) if v is None]
            new = {parts[n] for n in gaps}
            if old and (kept := {x: old[x] for x in new if x in old}):
                young.update(kept)
                self.held += ENTRY_BYTES * len(kept)
            if made := [x for x in new if x not in young]:
                pairs = list(zip(made, make(made)))
                short = [x for x in pairs if len(x[0]) <= LONG]
                if len(short) < len(pairs):
                    long = dict(x for x in pairs if len(x[0]) > LONG)
                young.update(short)
                # a value takes a few bytes for each byte of its part
                self.held += ENTRY_BYTES // 2 * len(short) + 4 * sum(len(x[0]) for x in short)
            for n in gaps:
                found[n] = young[parts[n]] if parts[n] in young else long[parts[n]]
            if len(young) > self.size or self.held > self.size * ENTRY_BYTES:
                self.old, self.young, self.held = young, {}, 0
        return found


def _byte_level(described: str) -> bool:
    """Whether a tokenizer cuts texts as GPT-2 does and merges bytes without chance, and does nothing else."""
    parts = json.loads(described)
    cut, model = parts["pre_tokenizer"] or {}, parts["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    return bool(plain and not parts["normalizer"] and model["type"] == "BPE" and not model["dropout"])


class Encoder:
    """Whole texts to ids, as bytes of little-endian unsigned 32-bit numbers.

    spaced: the pre-tokenizer joins one blank to the word behind it; otherwise the tokenizer drops
    white space and lower-cases.
    """

    def __init__(self, path: str, spaced: bool, parts: int = CACHE_PARTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.parts = Tokenizer.from_file(path), spaced, Parts(parts)
        self.heads = Parts(parts // 10)
        self.line = self._ids(["\n"])[0] if spaced else b""
        # a token of its own between words that are encoded as one text
        self.between = "\n" if spaced else f" {_BORDER} "
        self.border = self.tokenizer.encode(self.between, add_special_tokens=False).ids[0]
        self.marks = dict(zip(b".,", self._ids([".", ","])))
        self.model = self.tokenizer.model if _byte_level(self.tokenizer.to_str()) else None
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [pack(f"<{len(x)}I", *x.ids) for x in found]

    def _listed(self, words: list[bytes], lead: str) -> list[bytes]:
        """The ids of words without white space, of which many are encoded as one text."""
        out, between = [], (self.between + lead).encode()
        for a in range(0, len(words), 500):
            text = lead + between.join(words[a : a + 500]).decode()
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            data, at = pack(f"<{len(ids)}I", *ids), 0
            for stop in [4 * n for n, x in enumerate(ids) if x == self.border]:
                out.append(data[at:stop])
                at = stop + 4
            out.append(data[at:])
        return out

    def _lettered(self, words: list[bytes], lead: str) -> list[bytes]:
        """The ids of words of letters, each one piece for the model."""
        out, tokenize, lead = [], self.model.tokenize, "\u0120" if lead else ""
        for x in words:
            text = x.decode() if x.isascii() else x.decode("latin-1").translate(_CHARACTERS)
            ids = [t.id for t in tokenize(lead + text)]
            out.append(pack(f"<{len(ids)}I", *ids))
        return out

    def _cut(self, text: bytes, at: bytes | None = b" ") -> list[bytes]:
        """A text at its blanks (without loose ones), or at all ASCII white space, with commas and full stops behind words as parts of their own."""
        if not _BOUND.search(text):
            text = text.replace(b", ", b" " + _COMMA + b" ").replace(b". ", b" " + _STOP + b" ")
        return text.split(at)

    def _made(self, parts: list[bytes], lead: str) -> list[bytes]:
        """The ids of parts; a full stop or comma behind an ASCII letter or digit is always cut off."""
        for x, sign in ((_COMMA, b","), (_STOP, b".")):
            if x in parts:
                rest = [y for y in parts if y != x]
                made = dict(zip(rest, self._made(rest, lead))) | {x: self.marks[sign[0]]}
                return [made[y] for y in parts]
        stems = [x[:-1] if x[-1] in b".," and x[-2:-1].isalnum() else x for x in parts]
        words, known = list(dict.fromkeys(stems)), {}
        if self.model:
            letters = [x for x in words if _LETTERS.fullmatch(x)]
            known = dict(zip(letters, self._lettered(letters, lead)))
            words = [x for x in words if x not in known]
        if bool(lead) is self.spaced and not _ODD.search(b" ".join(words)):
            made = dict(zip(words, self._listed(words, lead)))
        else:
            made = dict(zip(words, self._ids([lead + x.decode() for x in words])))
        made.update(known)
        return [made[s] if s is x else made[s] + self.marks[x[-1]] for s, x in zip(stems, parts)]

    def _plain(self, parts: list[bytes]) -> list[bytes]:
        return self._made(parts, "")

    def _blank(self, parts: list[bytes]) -> list[bytes]:
        """The ids of parts behind a blank; the two sides of a line's end inside a part are looked up."""
        lines, whole = [], []
        for x in parts:
            if b"\n" in x:
                left, _, right = x.partition(b"\n")
                if _SOLID.fullmatch(left[-1:] + right[:1]) and b"\n" not in right:
                    lines.append((x, left, right))
                    continue
            whole.append(x)
        made = dict(zip(whole, self._made(whole, " ")))
        if lines:
            lefts = self.parts.values([x[1] for x in lines], self._blank)
            rights = self.heads.values([x[2] for x in lines], self._plain)
            made.update((x[0], a + self.line + b) for x, a, b in zip(lines, lefts, rights))
        return [made[x] for x in parts]

    def encode(self, text: bytes | None) -> bytes:
        """The ids of one text; null and empty texts have none."""
        if not text:
            return b""
        seen = text if self.spaced else text.lower()
        if any(x in seen for x in self.special):
            return self._ids([text.decode()])[0]
        if not self.spaced:
            found = self._cut(seen, None)
            return b"".join(self.parts.values(found, self._plain))
        found = _FIRM.split(text) if _LOOSE.search(text) else self._cut(text)
        head, rest = found[0], found[1:]
        first = self.heads.values([head], self._plain)[0] if head else b""
        return first + b"".join(self.parts.values(rest, self._blank))


@lru_cache(2)
def encoder(path: str, spaced: bool, parts: int = CACHE_PARTS) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path, spaced, parts)
