"""BPE encoding and decoding as streaming machines with bounded memory.

Encoding. Text is fed in chunks, cut into pre-tokens as it comes, and each pre-token goes through a transducer over its
symbols: the merge list has a sufficient lookahead, so a token is stable, and emitted, once that many symbols are known
behind it, or when the pre-token ends. What the transducer gave for a short pre-token is kept for reuse, up to a bound.

Lookahead. Seen as passes over the text in order of priority, an unknown continuation can only change
what lies left of it by a merge u+v in which v reaches into the unknown. That makes u unknown too, to
the rules of later rank whose right side begins with u. The largest sum of |u| along such a chain bounds
how far back the unknown reaches; `lookahead` finds it in one scan of the merge list. A suffix of a
token sequence is the encoding of its own text, so what was emitted can be forgotten.

Decoding. Tokens are mapped to bytes and these to text by an incremental UTF-8 machine that holds an
incomplete character until it ends; a tokenizer without a decoder joins token strings by spaces.

Unicode. Characters that older tables know and that aren't marks are normalised and classed by Python; texts
with others are normalised by the normaliser of the tokenizer file, and such characters are classed by what its own splitting
does with them, so that its tables count. Text is cut before characters that compose with nothing before
them; a run without any (marks, vowels and finals of Hangul) is held whole.

Supported are tokenizer files with a word-splitting pattern, byte-level symbols and an end-of-word
suffix. Null text is the empty text, which has no ids; special tokens in a text are those tokens.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import kept, table

CHUNK, CACHE = 1 << 16, 600_000
#: The split pattern of such files, as sets of letters and numbers, and white space.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _old(c: str) -> bool:
    """Known to the tables of Unicode 3.2, and neither a mark nor a part of a Hangul syllable."""
    return unicodedata.ucd_3_2_0.category(c) not in ("Cn", "Cs") and unicodedata.category(c)[0] != "M" and not "\u1100" <= c <= "\u11ff"


@cache
def usual() -> str:
    """The characters of the basic plane that need no table of the library, as ranges of a pattern."""
    out, first = [], None
    for i in range(0x10001):
        if i < 0x10000 and _old(chr(i)):
            first = i if first is None else first
        elif first is not None:
            out.append(f"\\u{first:04x}-\\u{i - 1:04x}")
            first = None
    return "".join(out)


def stands_alone(c: str) -> bool:
    """Composes with nothing before it: no mark, no vowel or final of Hangul, nothing that Python's tables don't know."""
    return c < "\x80" or (unicodedata.category(c) not in ("Mn", "Mc", "Me", "Cn") and not unicodedata.combining(c) and not "\u1160" <= c <= "\u11ff" and not "\ud7b0" <= c <= "\ud7ff")


def lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols that must be known behind a token to make it stable, for merges by priority."""
    reach: dict[str, int] = {}  # left side: how far back the unknown can reach by rules that merge it
    most = 0
    for u, v in merges:
        body = v.removesuffix(suffix) if suffix else v
        far = len(u) + max((reach.get(body[:i], 0) for i in range(1, len(body) + 1)), default=0)
        reach[u] = max(reach.get(u, 0), far)
        most = max(most, far)
    return most + 1  # the last known symbol may still become the last of its word


class Spelling:
    """Byte strings by number, joined for many numbers at once."""

    def __init__(self, pieces: list[bytes]):
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def join(self, ids: list[int]) -> bytes:
        at = np.array(ids, np.int64)
        n = self.length[at]
        first = np.cumsum(n) - n
        where = np.repeat(self.start[at] - first, n)
        where += np.arange(len(where))
        return self.bytes[where].tobytes()


class Tokenizer:
    """What a tokenizer file says, and the ids of words met so far."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        model, split = d["model"], (d.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or split.get("pattern", {}).get("Regex") != PATTERN:
            raise ValueError("a BPE file with an end-of-word suffix and this split pattern is needed")
        self.suffix, self.vocab = model["end_of_word_suffix"], model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.lookahead = lookahead(merges, self.suffix)
        self.symbol = byte_symbols()
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.token = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in chain(self.vocab.items(), self.special.items()):
            self.token[i] = t
        self.numbers = Spelling([b" %d" % i for i in range(len(self.token))])
        self.spelling = Decoder.spelling(self.token)
        library = Library.from_file(path)
        self.normaliser, self.splitter = library.normalizer, library.pre_tokenizer
        self.unusual = re.compile(f"[^{usual()}]")
        self.classes: dict[int, str] = {}  # of unusual characters met so far: a character of their class
        # what a run of letters or of other signs goes on with
        self.goes_on = {"L": regex.compile(r"\p{L}*"), "O": regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]*")}
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.split_ascii = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^{SPACE}A-Za-z0-9]+")
        self.letter = regex.compile(r"\p{L}")
        self.longest = max(1024, 2 * self.lookahead)  # symbols that the transducer holds before it looks for stable tokens
        self.known: dict[str, tuple] = _Known(self)

    def symbols(self, text: str) -> list[str]:
        return [self.symbol[b] for b in text.encode("utf-8")]

    def normal(self, raw: str) -> str:
        """Composed and in lower case, each character by itself: no final sigma."""
        if raw.isascii():
            return raw.lower()
        if self.unusual.search(raw):
            return self.normaliser.normalize_str(raw)
        return unicodedata.normalize("NFC", raw).replace("Σ", "σ").lower()

    def classed(self, text: str) -> str:
        """The text with one character of the same class in place of each unusual one."""
        if text.isascii() or not (found := set(self.unusual.findall(text))):
            return text
        size = lambda x: len(self.splitter.pre_tokenize_str(x))
        for c in found:
            if ord(c) not in self.classes:
                self.classes[ord(c)] = "x" if size("x" + c) == 1 else "#" if size("#" + c) == 1 else "0" if size("0" + c) == 2 else " "
        return text.translate(self.classes)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of normalised text."""
        if text.isascii():
            return self.split_ascii.findall(text)
        like = self.classed(text)
        return self.split.findall(text) if like is text else [text[m.start() : m.end()] for m in self.split.finditer(like)]

    def merge(self, s: list[str]) -> list[str]:
        """Merges the pair of the best rank, the leftmost first, until none is left."""
        if len(s) > 48:
            return self._merge_long(s)
        ranks = self.ranks
        while len(s) > 1:
            best, at = None, -1
            for i, pair in enumerate(zip(s, s[1:])):  # noqa: B905
                r = ranks.get(pair)
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def _merge_long(self, s: list[str]) -> list[str]:
        """The same with a queue of pairs, for long runs."""
        n = len(s)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(r, i, s[i] + s[i + 1]) for i in range(n - 1) if (r := self.ranks.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, made = heapq.heappop(queue)
            j = after[i]
            if s[i] is None or j < 0 or s[i] + s[j] != made or (s[i], s[j]) not in self.ranks:
                continue
            s[i], s[j], after[i] = made, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((s[a], s[b]))) is not None:
                    heapq.heappush(queue, (r, a, s[a] + s[b]))
        return [t for t in s if t is not None]


class Transducer:
    """Merges the symbols of one pre-token. feed() gives the ids of what has become stable, finish() those of the rest."""

    def __init__(self, tok: Tokenizer, longest: int | None = None):
        self.tok, self.longest, self.held = tok, longest or tok.longest, []

    def feed(self, symbols: list[str]) -> list[int]:
        self.held += symbols
        if len(self.held) <= self.longest:
            return []
        out, at, most = [], 0, len(self.held) - self.tok.lookahead
        for t in self.tok.merge(self.held[:]):
            if at + len(t) > most:
                break
            out.append(self.tok.vocab[t])
            at += len(t)
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        self.held[-1] += self.tok.suffix
        return [self.tok.vocab[t] for t in self.tok.merge(self.held)]


class _Known(dict):
    """ids of pre-tokens as the transducer gives them; the oldest half goes when it is full."""

    def __init__(self, tok: Tokenizer):
        super().__init__()
        self.tok = tok

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            for k in list(islice(self, CACHE // 2)):
                del self[k]
        machine = Transducer(self.tok)
        ids = (*machine.feed(self.tok.symbols(word)), *machine.finish())
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """Feeds give the ids that have become stable, finish() the rest. Holds a bounded part of the text."""

    def __init__(self, tok: Tokenizer, longest: int | None = None):
        self.tok = tok
        self.longest = longest or tok.longest  # symbols of a pre-token that are held whole
        self.raw = ""  # text that isn't normalised yet
        self.text = ""  # normalised text from the first pre-token that may go on
        self.run: tuple[str, Transducer] | None = None  # kind and machine of a pre-token that is being emitted

    def feed(self, chunk: str) -> list[int]:
        self.raw += chunk
        cut = self._cut()
        if not cut:
            return []
        head, self.raw = self.raw[:cut], self.raw[cut:]
        return self._through_specials(head, False)

    def finish(self) -> list[int]:
        head, self.raw = self.raw, ""
        return self._through_specials(head, True)

    def _cut(self) -> int:
        """Where normalisation can be cut: before a character that composes with nothing before it and starts no special token, at best a space."""
        raw = self.raw
        at = raw.rfind(" ")
        if at > 0:
            return at
        for i in range(len(raw) - 1, 0, -1):
            if stands_alone(raw[i]) and not self._in_special(raw, i):
                return i
        return 0

    def _in_special(self, raw: str, i: int) -> bool:
        for s in self.tok.special:
            for k in range(1, min(len(s), i + 1)):
                if raw[i - k : i] == s[:k] and s.startswith(raw[i - k : i - k + len(s)]):
                    return True
        return False

    def _through_specials(self, raw: str, last: bool) -> list[int]:
        if "<" not in raw or not self.tok.specials.search(raw):
            return self._words(self.tok.normal(raw), last)
        out: list[int] = []
        at = 0
        for m in self.tok.specials.finditer(raw):
            out += self._words(self.tok.normal(raw[at : m.start()]), True)
            out.append(self.tok.special[m[0]])
            at = m.end()
        return out + self._words(self.tok.normal(raw[at:]), last)

    def _words(self, fresh: str, last: bool) -> list[int]:
        """ids of the pre-tokens that are complete in what is held and `fresh`."""
        out: list[int] = []
        if self.run:
            kind, machine = self.run
            more = fresh[: self.tok.goes_on[kind].match(self.tok.classed(fresh)).end()]
            fresh = fresh[len(more) :]
            out += machine.feed(self.tok.symbols(more))
            if not fresh and not last:
                return out
            out += machine.finish()
            self.run = None
        text = self.text + fresh
        found = self.tok.pieces(text)
        if last:
            self.text = ""
        else:
            keep = len(text)  # from where a pre-token may still change
            if found and text.endswith(found[-1]):
                keep -= len(found.pop())
                if found and text[keep - 1] == "'" and text[keep:] in ("r", "v", "l"):
                    keep -= len(found.pop())
            self.text = text[keep:]
        out += chain.from_iterable(map(self.tok.known.__getitem__, found))
        if len(self.text) > self.longest:
            machine = Transducer(self.tok, self.longest)
            self.run = "L" if self.tok.letter.match(self.tok.classed(self.text)) else "O", machine
            out += machine.feed(self.tok.symbols(self.text))
            self.text = ""
        return out


class Decoder:
    """Text of ids, fed piece by piece; an incomplete character waits for its other bytes.

    spelling: the bytes of each token, made once by spelling() for what the file names as its decoder. Without
    one, token strings are joined by spaces.
    """

    def __init__(self, spelling: Spelling, decoder: str | None = None):
        self.pieces, self.skip = spelling, decoder is None  # the space before the first token
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    @staticmethod
    def spelling(token: list[str], decoder: str | None = None) -> Spelling:
        if decoder is None:
            return Spelling([b" " + t.encode() for t in token])
        byte = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
        return Spelling([b"".join(byte.get(c) or c.encode() for c in t) for t in token])

    def feed(self, ids: list[int]) -> str:
        raw = self.pieces.join(ids)
        if self.skip and raw:
            raw, self.skip = raw[1:], False
        return self.utf8.decode(raw)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


def encoded(text: str, tok: Tokenizer, chunk: int = CHUNK) -> Iterator[list[int]]:
    """ids of a text, chunk by chunk."""
    machine = Encoder(tok)
    for a in range(0, len(text), chunk):
        yield machine.feed(text[a : a + chunk])
    yield machine.finish()


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of each row of docs (doc_id, text)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = kept(("bpe", path), lambda: Tokenizer(path))
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = [list(chain.from_iterable(encoded(t or "", tok))) for t in part.column(1).to_pylist()]
                texts = []
                for x in ids:
                    d = Decoder(tok.spelling)
                    texts.append(d.feed(x) + d.finish())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids go from encoder to decoder and digests as they come."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = kept(("bpe", path), lambda: Tokenizer(path))
        for batch in batches:
            out = []
            for text in batch.column(1):
                n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(tok.spelling)
                for ids in encoded(text.as_py() or "", tok):
                    if ids:
                        numbers = tok.numbers.join(ids)
                        ids_hash.update(numbers if n else numbers[1:])
                        text_hash.update(decoder.feed(ids).encode())
                        n += len(ids)
                text_hash.update(decoder.finish().encode())
                out.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
