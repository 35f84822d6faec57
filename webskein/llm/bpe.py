"""BPE as a bounded-lookahead streaming transducer, with an incremental decoder.

``lookahead`` is computed from the merge list: how far to the left what follows can still change tokens. A merge rule (w, x) of some rank can free or
feed only rules of later rank whose right side begins with w, so that a longest chain of rules of rising rank bounds the reach; the longest token is added.

One path serves every text. ``Transducer`` takes text piece by piece. It cuts where neither normalising nor a special token can reach across, splits what is certain into words, and carries an unfinished word on; a word longer than a
piece goes on as symbols. ``window`` reads a word's symbols, emits every token that ends before the lookahead as soon as twice that length is read, goes on from the last boundary
emitted, and empties at the word's end. Short words come from a small memo; it has two generations, so that frequent words stay when rare ones have filled it. Words of a few texts that the memo lacks are learned
together, before these are streamed: as the rows of one array, where each step merges the best pair of every word. Memory is constant however long a text or a word is
(only a run of combining marks is held whole).

``Decoder`` is a state machine that turns one id after the other into text: as the tokenizers library does without a decoder (tokens joined by blanks), or from the byte alphabet into UTF-8
text, where it holds at most three bytes of an unfinished character.

Supported files: BPE with a byte alphabet, optional end-of-word suffix, special tokens taken from raw text, and the normalising and splitting steps of ``word_bpe_49k.json``; others are refused.

Defined results. A null text is an empty one: no ids, the digests of nothing. Each input row gives one row, repeated and null ids included. Whole texts of any
length are read. An empty table gives no rows. Only the named columns are read; kept ones may have any names but those of the results.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webskein.llm.text import small

#: White space of the Unicode property, which str.split() exceeds by four control characters.
BLANK = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f"[^{BLANK}]+")
CONTROL = re.compile("[\x1c-\x1f]")
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
ANY_WORD = regex.compile(WORD.replace(r"\s", BLANK))
#: Letters and numbers that ``regex`` has and the library's older tables haven't: it takes them as other signs.
NEWER = "".join(
    "-".join(chr(int(x, 16)) for x in r.split("-"))
    for r in (
        "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
        "16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
    ).split()
)
HAS_NEWER = re.compile(f"[{NEWER}]")
#: Runs of the same class, that a cut within a word goes on with: letters, or neither letters, numbers nor blanks.
ONE_LETTER, ONE_OTHER = rf"[\p{{L}}--[{NEWER}]]", rf"[[{NEWER}]||[^{BLANK}\p{{L}}\p{{N}}]]"
LETTERS, OTHERS = regex.compile(f"(?V1){ONE_LETTER}+"), regex.compile(f"(?V1){ONE_OTHER}+")
EXACT_WORD = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{ONE_LETTER}+|[\p{{N}}--[{NEWER}]]|{ONE_OTHER}+")
#: Capitals that the library lower-cases and Python's older tables don't.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7DC: 0x19B} | {c: c + 1 for c in (0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)} | {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
HAS_CAPITAL = re.compile(f"[{''.join(map(chr, LOWER))}]")
MEMO = 1 << 16  # words and chunks of a generation
MEMO_LENGTH = 48
PIECE = 1 << 16
AHEAD = 1 << 18  # code points of short texts whose words are learned together
NEVER = 1 << 60
HEAP = 96  # symbols from which merging takes a heap
SIDE = 24  # bytes of a word that merges side by side with others
FEW, MANY = 64, 2048  # words for which that pays, and that are taken at once
NONE = 0xFFFFF  # no symbol: stands behind a word's end


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after which a token can't change any more; merges in order of rank, as strings of one character a symbol."""
    reach: dict[str, int] = {}
    most, longest = 0, 1
    for left, right in reversed(merges):
        n = len(left) + reach.get(left, 0)
        most, longest = max(most, n), max(longest, len(left) + len(right))
        for k in range(1, len(right) + 1):
            if reach.get(right[:k], 0) < n:
                reach[right[:k]] = n
    return most + longest


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or split["pattern"].get("Regex") != WORD or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a tokenizer of another kind")
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = token.encode()
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.suffix] for c in alphabet]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: (r << 20) | vocab[a + b] for r, (a, b) in enumerate(merges)}
        self.keys = np.array([*sorted(self.ranks), 1 << 62])  # nothing has the last one
        self.values = np.array([self.ranks.get(k, NEVER) for k in self.keys.tolist()])
        self.symbols = np.array([*self.inner, *self.last, NONE])
        self.pairs = self.looked_up(self.symbols[:, None], self.symbols[None, :])
        # a word's last byte is one symbol with the suffix
        one = lambda s: s[: -len(self.suffix) - 1] + chr(0xE000 + ord(s[-len(self.suffix) - 1])) if self.suffix and s.endswith(self.suffix) else s
        self.lookahead = lookahead([(one(a), one(b)) for a, b in merges])
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before
        self.early = self.ended = 0  # tokens given out before their word's end; words that ended

    def merge(self, ids: list[int]) -> list[int]:
        """All merges within a window, lowest rank first, leftmost first."""
        if len(ids) > HEAP:
            return self.merge_long(ids)
        get = self.ranks.get
        found = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != NEVER:
            i = found.index(best)
            ids[i] = new = best & 0xFFFFF
            del found[i], ids[i + 1]
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | new, NEVER)
            if i < len(found):
                found[i] = get(new << 20 | ids[i + 1], NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs and a linked list of symbols."""
        get, n = self.ranks.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1], NEVER)) != NEVER]
        heapify(heap)
        while heap:
            best, i, a, b = heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = best & 0xFFFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := get(ids[x] << 20 | ids[y], NEVER)) != NEVER:
                    heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def width(self, token: int) -> int:
        """Symbols of a token."""
        s = self.pieces[token].decode()
        return len(s.removesuffix(self.suffix)) if self.suffix else len(s)

    def word(self, w: str) -> bytes:
        """The ids of a word, as little-endian 32-bit integers."""
        x = Window(self)
        return array("I", x.push(w) + x.end()).tobytes()

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """ranks of many pairs."""
        key = left << 20 | right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.values[at], NEVER)

    def side_by_side(self, words: list[str]) -> list[bytes]:
        """word() of many words of at most SIDE bytes. Each step merges one pair, of lowest rank and leftmost, in all words that still have one."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        width = int(size.max())
        at = np.full((len(raw), width), 512)
        at[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        row = np.arange(len(raw))
        at[row, size - 1] += 256
        ids, found = self.symbols[at], self.pairs[at[:, :-1], at[:, 1:]]
        out = np.full(ids.shape, NONE)
        while width > 1:
            best = found.argmin(1)
            value = found[np.arange(len(row)), best]
            go = value != NEVER
            if not go.all():
                out[row[~go], :width] = ids[~go]
                row, ids, found, best, value = row[go], ids[go], found[go], best[go], value[go]
            if not len(row):
                break
            i = np.arange(len(row))
            stay = np.ones(ids.shape, bool)
            stay[i, best + 1] = False
            width -= 1
            ids = ids[stay].reshape(-1, width)
            ids[i, best] = value & 0xFFFFF
            stay = np.ones(found.shape, bool)
            stay[i, best] = False
            found = found[stay].reshape(-1, width - 1)
            if width > 1:
                for j in (np.maximum(best - 1, 0), np.minimum(best, width - 2)):
                    found[i, j] = self.looked_up(ids[i, j], ids[i, j + 1])
        out[row, :width] = ids
        self.ended += len(raw)
        there = out != NONE
        flat, ends = out[there].astype("<u4").tobytes(), (4 * there.sum(1).cumsum()).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, found: dict[str, bytes]) -> None:
        if len(self.memo) >= MEMO:
            self.memo, self.old = {}, self.memo
        self.memo.update({w: ids for w, ids in found.items() if len(w) <= MEMO_LENGTH})

    def chunks(self, cs: set[str]) -> dict[str, bytes]:
        """The ids of what stands between blanks."""
        done = {c: self.old[c] for c in cs & self.old.keys()}
        new = cs.difference(done)
        parts = {c: split(c) for c in new if not c.isalpha()}
        words = {w for ws in parts.values() for w in ws}.union(new.difference(parts))
        for held in (self.memo, self.old):
            done |= {w: held[w] for w in words & held.keys()}
        words.difference_update(done)
        short = [w for w in words if len(w) <= SIDE and (w.isascii() or len(w.encode()) <= SIDE)]
        if len(short) < FEW:
            short = []
        for at in range(0, len(short), MANY):
            done.update(zip(short[at : at + MANY], self.side_by_side(short[at : at + MANY])))
        done |= {w: self.word(w) for w in words.difference(short)}
        done |= {c: b"".join([done[w] for w in ws]) for c, ws in parts.items() if len(ws) > 1}
        self.learn(done)
        return done

    def ahead(self, texts: Iterable[str | None]) -> None:
        """Learn the words of short texts together. This only fills the memo: whatever isn't learned here, stream() finds by itself."""
        new: set[str] = set()
        for t in texts:
            if t and len(t) <= PIECE:
                new.update(t.lower().split() if t.isascii() else CHUNK.findall(normal(t)))
        new.difference_update(self.memo)
        self.chunks(new)

    def stream(self, text: str | None) -> Iterator[bytes]:
        """Ids of a whole text piece by piece, as little-endian 32-bit integers."""
        t = Transducer(self)
        if len(text or "") <= PIECE:
            t.raw = text or ""
            yield from t.end()
            return
        for at in range(0, len(text), PIECE):
            yield from t.push(text[at : at + PIECE])
        yield from t.end()

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.stream(text))


def normal(text: str) -> str:
    # character by character: without the rule for a final sigma
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return text.translate(LOWER) if HAS_CAPITAL.search(text) else text


def split(chunk: str) -> list[str]:
    """The words of what stands between blanks."""
    if chunk.isascii():
        return ASCII_WORD.findall(chunk)
    return (EXACT_WORD if HAS_NEWER.search(chunk) else ANY_WORD).findall(chunk)


class Window:
    """A word's symbols, of which at most twice the lookahead are held. push() gives the tokens that are stable, end() the rest."""

    __slots__ = ("bpe", "held", "last")

    def __init__(self, bpe: Bpe):
        self.bpe, self.held, self.last = bpe, [], -1  # the last byte waits, as its symbol is another one at the word's end

    def push(self, part: str) -> list[int]:
        bpe, raw = self.bpe, part.encode()
        if self.last >= 0:
            self.held.append(bpe.inner[self.last])
        self.held += [bpe.inner[b] for b in raw[:-1]]
        self.last = raw[-1]
        out, full = [], 2 * bpe.lookahead
        while len(self.held) >= full:
            at = 0
            for t in bpe.merge(self.held[:full]):
                n = bpe.width(t)
                if at + n > full - bpe.lookahead:
                    break
                at += n
                out.append(t)
                bpe.early += 1
            del self.held[:at]
        return out

    def end(self) -> list[int]:
        self.bpe.ended += 1
        return self.bpe.merge([*self.held, self.bpe.last[self.last]])


def apart(c: str) -> bool:
    """Whether normalising never joins a character to what is before it."""
    return c < "\u0300" or not (unicodedata.category(c)[0] == "M" or "\u1100" <= c <= "\u11ff")


class Transducer:
    """push() takes text and gives the ids that are certain by then, end() the rest.

    Its state: raw text that what follows may still change, an unfinished word, and, of a word longer than a piece, the window that its symbols go through."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.raw = self.open = ""
        self.back = max(map(len, bpe.special), default=0)
        self.window: Window | None = None
        self.same = LETTERS  # the class of a long word's signs

    def push(self, text: str) -> Iterator[bytes]:
        self.raw += text
        cut = len(self.raw) - self.back
        while cut > 0:
            across = [m.start() for m in self.bpe.cut.finditer(self.raw, max(0, cut - self.back + 1), cut + self.back - 1) if m.start() < cut < m.end()] if self.bpe.cut else []
            if across:
                cut = across[0]
                continue
            if apart(self.raw[cut]):
                break
            cut -= 1
        if cut > 0:
            sure, self.raw = self.raw[:cut], self.raw[cut:]
            yield from self.pieces(sure, False)

    def end(self) -> Iterator[bytes]:
        sure, self.raw = self.raw, ""
        yield from self.pieces(sure, True)

    def pieces(self, text: str, final: bool) -> Iterator[bytes]:
        at = 0
        for m in self.bpe.cut.finditer(text) if self.bpe.cut else ():
            yield from self.plain(text[at : m.start()], True)
            yield self.bpe.special[m.group()].to_bytes(4, "little")
            at = m.end()
        yield from self.plain(text[at:] if at else text, final)

    def plain(self, text: str, final: bool) -> Iterator[bytes]:
        """A stretch without special tokens; ``final``: its last word ends with it."""
        text = text.lower() if text.isascii() else normal(text)
        if self.window:
            m = self.same.match(text)
            stop = m.end() if m else 0
            if stop:
                yield from self.go_on(text[:stop])
            if stop == len(text) and not final:
                return
            yield array("I", self.window.end()).tobytes()
            self.window, text = None, text[stop:]
        text, self.open = self.open + text, ""
        parts = text.split() if text.isascii() and not CONTROL.search(text) else CHUNK.findall(text)
        if final or not parts or not text.endswith(parts[-1]):
            yield self.joined(parts)
            return
        words = split(parts.pop())
        self.open = words.pop()
        if self.open in ("r", "v", "l") and words and words[-1] == "'":  # perhaps 're, 've or 'll
            self.open = words.pop() + self.open
        yield self.joined(parts)
        yield self.joined(words)
        if len(self.open) >= PIECE:
            self.same = LETTERS if LETTERS.match(self.open) else OTHERS
            self.window, part, self.open = Window(self.bpe), self.open, ""
            yield from self.go_on(part)

    def joined(self, parts: list[str]) -> bytes:
        out = list(map(self.bpe.memo.get, parts))
        if None in out:
            new = self.bpe.chunks({p for p, ids in zip(parts, out) if ids is None})
            out = [ids or new[p] for p, ids in zip(parts, out)]
        return b"".join(out)

    def go_on(self, part: str) -> Iterator[bytes]:
        for at in range(0, len(part), 4096):
            yield array("I", self.window.push(part[at : at + 4096])).tobytes()


class Decoder:
    """push() takes ids and returns the text that is certain by then; end() the rest. Its state: whether a token came, and an unfinished character."""

    def __init__(self, bpe: Bpe, joined: bool = True):
        self.bpe, self.joined, self.started = bpe, joined, False
        self.rest = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int] | array) -> str:
        if not ids:
            return ""
        if self.joined:
            text = b" ".join(map(self.bpe.pieces.__getitem__, ids)).decode()
            text, self.started = " " * self.started + text, True
            return text
        out = []
        for i in ids:
            token = self.bpe.pieces[i].decode()
            if token in self.bpe.special:
                out.append(self.rest.decode(b"", True) + token)
                self.rest.reset()
                continue
            ends = bool(self.bpe.suffix) and token.endswith(self.bpe.suffix)
            raw = bytes(self.bpe.byte_of[c] for c in (token.removesuffix(self.bpe.suffix) if ends else token))
            out.append(self.rest.decode(raw + b" " * ends))
        return "".join(out)

    def end(self) -> str:
        return self.rest.decode(b"", True)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One for each worker process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]



def tokenize(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, keep's columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids. path: the tokenizer's file, at the same place on all executors."""
    keep = keep or {}
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *(c.alias(n) for n, c in keep.items()), F.col(text).alias("__text"))
    at = len(rows.columns) - 1

    def run(batches):
        bpe = load(path)
        for b in small(batches, at, AHEAD):
            n, one, two, ids = [], [], [], []
            texts = b.column(at).to_pylist()
            bpe.ahead(texts)
            for t in texts:
                decoder, raw, said, count, own = Decoder(bpe), hashlib.sha256(), hashlib.sha256(), 0, []
                for part in bpe.stream(t):
                    raw.update(part)
                    said.update(decoder.push(array("I", part)).encode())
                    count += len(part) // 4
                    if with_ids:
                        own.append(part)
                said.update(decoder.end().encode())
                n.append(count), one.append(raw.hexdigest()), two.append(said.hexdigest()), ids.append(b"".join(own))
            cols = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            names = [*b.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", *["ids array<int>"] * with_ids]
    return rows.mapInArrow(run, ", ".join(schema))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
