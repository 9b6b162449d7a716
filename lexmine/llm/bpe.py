"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of the 16 bytes before a character says so, so equal passages are cut
alike in every document, wherever they stand and even inside a word. A chunk is encoded once:

1. A first pass counts the documents that hold each chunk (by its hash). The chunks whose reuse saves most
   are encoded by one job, and their ids are shared with every worker; their number is bounded.
2. A second pass puts every text together from its chunks. A worker encodes a chunk that isn't shared at
   its first sight and remembers it within a bound. Where the tokenizer is known to take words apart (`by_word`), the
   library gets the words, or parts of words, that the worker doesn't remember, each once, and not the whole chunk.
3. Joins are repaired. The words around a join are encoded again as one, from one whole word before the cut
   word to one whole word after it. If the chunks' own ids agree with the outer words', only the ids
   in between are replaced; if not, more words are taken, at last both whole chunks.

Texts and ids are never shuffled, only hashes and counts of chunks.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import as_bytes, slices

#: One character in so many ends a chunk (a power of 2); words that end in a chunk at least; words taken on either side of a join at the first and second try.
EVERY, ENDS, TRIES = 2048, 6, (2, 8)
#: Chunks shared over the cluster at most and bytes of each at most; bytes of chunks and number of joins that a worker remembers at most.
SHARED, SHARED_BYTES, CHUNK_BYTES, MEMO = 4096, 8192, 16_000_000, 50_000
#: Texts that the library gets at once.
CALL = 2048
#: Bytes of words that a worker remembers at most, each with so many for the objects that hold it; bytes of a word that is remembered.
WORD_BYTES, WORD_COST, WORD_LONG = 60_000_000, 180, 64
#: Patterns of pre-tokenizers (kept matches) that match no white space, so that a match never reaches over a word's end, with what they are on ASCII.
SPLITS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+": re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+")}


def word_ends(raw: np.ndarray) -> np.ndarray:
    """Places of the white space right after a printable ASCII character: no token reaches over them."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    return np.flatnonzero(space[1:] & (raw[:-1] > 32) & (raw[:-1] < 127)) + 1


def words(text: bytes) -> list[bytes]:
    """The text cut at its word ends: each part but the first begins with all of its white space."""
    ends = word_ends(np.frombuffer(text, np.uint8)).tolist() if text else []
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]


def by_word(tokenizer: dict) -> bool:
    """Are the ids of a text those of its words (parted by ASCII white space, and without it), one after another, whatever the text? Judged by the tokenizer's parts, from its JSON.

    Composition and lower case look at no character across ASCII white space; the pattern matches none, however it
    is squeezed; byte levels and merges see one match. Tokenizers with other parts aren't judged: no.
    """
    normal, split = tokenizer.get("normalizer"), tokenizer.get("pre_tokenizer") or {}
    parts = normal.get("normalizers", [normal]) if normal else []
    plain = all(p["type"] in ("NFC", "Lowercase") or (p["type"] == "Replace" and p["pattern"] == {"Regex": r"\s+"} and p["content"] == " ") for p in parts)
    steps = split.get("pretokenizers", [])
    known = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["pattern"].get("Regex") in SPLITS and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
    known = known and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in tokenizer.get("added_tokens", []))
    model = tokenizer["model"]
    return plain and known and added and tokenizer.get("post_processor") is None and model["type"] == "BPE" and not model.get("dropout") and not model.get("fuse_unk")


def candidates(raw: np.ndarray, every: int = EVERY, block: int = 1 << 22) -> np.ndarray:
    """Starts of characters whose 16 bytes before hash to 0 in every."""
    found = []
    for a in range(16, len(raw), block):
        part = raw[a - 16 : min(len(raw), a + block)]
        pair = np.ndarray(len(part) - 15, "<u8", part.tobytes() + bytes(8), strides=(1,))
        far = np.ndarray(len(part) - 15, "<u8", part.tobytes() + bytes(8), 8, strides=(1,))
        mixed = (pair * np.uint64(0x9E3779B97F4A7C15)) ^ (far * np.uint64(0xD1342543DE82EF95))
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero(mixed >> np.uint64(64 - every.bit_length() + 1) == 0)[: len(part) - 16] + a
        found.append(at[at < len(raw)])
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    return at[(raw[at] & 0xC0) != 0x80]


def cuts(text: bytes, every: int = EVERY) -> tuple[list[int], np.ndarray]:
    """Ends of the chunks, each with at least ENDS word ends, and all word ends of the text."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < 64:
        return [len(raw)], np.zeros(0, np.int64)
    ends = word_ends(raw)
    at = candidates(raw, every)
    seen, out, last = np.searchsorted(ends, at).tolist(), [], 0
    for place, n in zip(at.tolist(), seen, strict=True):
        if n - last >= ENDS and len(ends) - n > ENDS:
            out.append(place)
            last = n
    return [*out, len(raw)], ends


class Encoder:
    """A tokenizer with memories of chunks (those shared over the cluster, those of this worker) and of joins."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.names = [self.tokenizer.id_to_token(k) or "" for k in range(max(self.tokenizer.get_vocab(True).values()) + 1)]
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str("ab cd\tef\n gh") if self.tokenizer.pre_tokenizer else []
        #: Do tokens end where words end? Only then may a text be cut.
        self.cuttable = len(pieces) >= 4
        self.chunks: dict[bytes, bytes] = {}
        self.joins: dict[tuple[bytes, bytes], tuple[bytes, bytes, bytes]] = {}
        self.held = 0
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.by_word = self.cuttable and by_word(parts)
        if self.by_word:
            normal = parts.get("normalizer") or {}
            self.lowers = any(p["type"] == "Lowercase" for p in normal.get("normalizers", [normal]) if p)
            self.matches = SPLITS[parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]]
            added = [re.escape(t["content"].encode()) for t in parts.get("added_tokens", [])]
            self.added = re.compile(b"|".join(added) or rb"(?!)", re.IGNORECASE)
        #: Words met lately, and those met before them; a word met again moves to the first.
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.word_bytes = 0

    def library(self, texts: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 4 bytes each) of each text; a call of the library takes CALL texts, as what it returns holds far more than ids."""
        calls = (self.tokenizer.encode_batch_fast([t.decode() for t in texts[k : k + CALL]], add_special_tokens=False) for k in range(0, len(texts), CALL))
        return [struct.pack(f"<{len(ids)}I", *ids) for call in calls for ids in (e.ids for e in call)]

    def cut(self, text: bytes) -> list[bytes]:
        """The words of a text, A-Z in lower case if the tokenizer lowers them itself.

        Not so beside marks that compose with letters (in U+0300 to U+036F, first byte CC or CD), as some compose with
        small letters alone, nor where an added token might come of it.
        """
        if self.lowers and b"\xcc" not in text and b"\xcd" not in text and not self.added.search(text):
            return text.lower().split()
        return words(text)

    def pieces(self, word: bytes) -> list[bytes]:
        """Parts of a word whose ids are the word's ids: the pattern's matches in ASCII, of which an added token is none."""
        if word.isalpha() or not word.isascii() or (self.lowers and word != word.lower()) or self.added.search(word):
            return [word]
        return self.matches.findall(word)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """As library(), but of words and parts that this worker remembers where the tokenizer takes words apart."""
        if not self.by_word:
            return self.library(texts)
        own = [self.cut(t) for t in texts]
        if self.word_bytes > WORD_BYTES // 2:
            self.before, self.words, self.word_bytes = self.words, {}, 0
        unknown = self._forgotten(set().union(*own))
        apart = {w: p for w in unknown if len(p := self.pieces(w)) > 1}
        new = list(unknown.difference(apart) | self._forgotten({x for p in apart.values() for x in p}).difference(apart))
        self.words.update(zip(new, self.library(new), strict=True))
        self.words.update({w: b"".join(map(self.words.__getitem__, p)) for w, p in apart.items()})
        out = [b"".join(map(self.words.__getitem__, x)) for x in own]
        for word in [*new, *apart]:
            if len(word) > WORD_LONG:
                del self.words[word]
            else:
                self.word_bytes += WORD_COST + len(word) + len(self.words[word])
        return out

    def _forgotten(self, wanted: set[bytes]) -> set[bytes]:
        """The wanted ones that this worker doesn't remember; those from before move to the latest."""
        wanted = wanted.difference(self.words)
        again = {w: self.before[w] for w in wanted if w in self.before}
        self.words.update(again)
        self.word_bytes += sum(WORD_COST + len(w) + len(x) for w, x in again.items())
        return wanted.difference(again)

    def plain(self, ids: bytes) -> str:
        """The library's decode() of ids; without a decoder it joins the tokens with spaces."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(numbers, skip_special_tokens=False)
        return " ".join(map(self.names.__getitem__, numbers))

    def parts(self, text: bytes) -> tuple[list[int], np.ndarray]:
        return cuts(text) if self.cuttable else ([len(text)], np.zeros(0, np.int64))

    def learn(self, chunks: set[bytes], shared: dict[bytes, bytes]) -> None:
        """Encode the chunks not met before, in one call."""
        new = [c for c in chunks if c not in self.chunks and c not in shared]
        if self.held > CHUNK_BYTES:
            self.chunks = {c: self.chunks[c] for c in chunks if c in self.chunks}
            self.held = sum(len(c) + len(i) for c, i in self.chunks.items())
        for chunk, ids in zip(new, self.ids(new), strict=True):
            self.chunks[chunk] = ids
            self.held += len(chunk) + len(ids)

    def learn_joins(self, pairs: set[tuple[bytes, bytes]]) -> None:
        """Ids of the words before and after joins, and of both together."""
        if len(self.joins) > MEMO:
            self.joins.clear()
        new = [p for p in pairs if p not in self.joins]
        both = self.ids([x for a, b in new for x in (a, b, a + b)])
        for k, p in enumerate(new):
            self.joins[p] = both[3 * k], both[3 * k + 1], both[3 * k + 2]

    def encode(self, texts: list[bytes], shared: dict[bytes, bytes] | None = None) -> list[bytes]:
        """Ids of whole texts, put together from their chunks."""
        shared, found = shared or {}, [self.parts(t) for t in texts]
        level = [dict.fromkeys(stops[:-1], 0) for stops, _ in found]
        while True:
            around = [_around(text, stops, ends, [TRIES[level[k][c]] for c in stops[:-1]]) for k, (text, (stops, ends)) in enumerate(zip(texts, found, strict=True))]
            self.learn({text[a:b] for text, (stops, _) in zip(texts, found, strict=True) for a, b in zip([0, *stops], stops, strict=False)}, shared)
            self.learn_joins({p for own in around for p in own if p})
            out, again = [], []
            for k, (text, (stops, _)) in enumerate(zip(texts, found, strict=True)):
                chunks = [text[a:b] for a, b in zip([0, *stops], stops, strict=False)]
                ids = [shared[c] if c in shared else self.chunks[c] for c in chunks]
                pairs = around[k]
                bad = [c for n, c in enumerate(stops[:-1]) if not self._fits(ids[n], ids[n + 1], pairs[n])]
                again.append(bad)
                out.append(b"" if bad else self._joined(ids, pairs))
            if not any(again):
                return out
            for k, bad in enumerate(again):
                for c in bad:
                    level[k][c] += 1
                    if level[k][c] == len(TRIES):  # they only agree as one
                        found[k][0].remove(c)

    def _fits(self, left: bytes, right: bytes, pair: tuple[bytes, bytes] | None) -> bool:
        """Do the chunks' ids agree with those of the words around the join, and these with the outer words' in the joined form?"""
        if not pair:
            return False
        a, b, both = self.joins[pair]
        return bool(a and b) and left.endswith(a) and right.startswith(b) and both[:4] == a[:4] and both[-4:] == b[-4:]

    def _joined(self, ids: list[bytes], pairs: list[tuple[bytes, bytes]]) -> bytes:
        out, start = [], 0
        for n, pair in enumerate(pairs):
            a, b, both = self.joins[pair]
            out += [ids[n][start : len(ids[n]) - len(a)], both]
            start = len(b)
        return b"".join([*out, ids[-1][start:]])


def _around(text: bytes, stops: list[int], ends: np.ndarray, tries: list[int]) -> list[tuple[bytes, bytes] | None]:
    """For each cut, the text of so many words before and after it, from word end to word end; None if that would leave its chunks or meet other joins."""
    cuts_, n = np.array(stops[:-1], np.int64), np.array(tries, np.int64)
    if not len(cuts_):
        return []
    before, after = np.searchsorted(ends, cuts_) - n, np.searchsorted(ends, cuts_, "right") + n - 1
    low, high = np.r_[0, cuts_[:-1]], np.array(stops[1:], np.int64)
    inside = (before >= 0) & (after < len(ends))
    a, b = ends[np.maximum(before, 0)], ends[np.minimum(after, len(ends) - 1)]
    left, right = _middle(ends, low, cuts_), _middle(ends, cuts_, high)  # joins on both sides of a chunk never overlap
    left[0], right[-1] = low[0], high[-1]
    inside &= (a >= left) & (b <= right)
    return [(text[x:c], text[c:y]) if ok else None for x, c, y, ok in zip(a.tolist(), stops, b.tolist(), inside.tolist(), strict=False)]


def _middle(ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The middle ones of the word ends between two places."""
    return ends[(np.searchsorted(ends, low) + np.searchsorted(ends, high)) // 2]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _hash(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def shared_chunks(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, most: int = SHARED) -> dict[bytes, bytes]:
    """Ids of the chunks whose reuse saves most bytes over all documents, most of them at most; each is encoded once, by one job."""

    def count(batches):
        for batch in (part for big in batches for part in slices(big, 1)):
            held: dict[int, list[int]] = {}
            for k, text in enumerate(as_bytes(batch.column(1))):
                stops, _ = encoder(tokenizer).parts(text)
                if len(text) >= 64:
                    for chunk in {text[a:b] for a, b in zip([0, *stops], stops, strict=False)}:
                        h = _hash(chunk)
                        if h in held:
                            held[h][1] += 1
                        elif len(chunk) <= SHARED_BYTES:
                            held[h] = [k, 1, len(chunk)]
            own = list(held.values())
            columns = [pa.array(list(held), pa.int64()), batch.column(0).take(pa.array([x[0] for x in own], pa.int32())), *(pa.array([x[k] for x in own], pa.int64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "i", "n", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    seen = rows.mapInArrow(count, f"h long, i {kind}, n long, size long").groupBy("h").agg(F.min("i").alias("i"), F.sum("n").alias("n"), F.max("size").alias("size"))
    top = seen.where("n > 1 AND i IS NOT NULL").orderBy(F.desc(F.expr("(n - 1) * size")), "h").limit(most).select("h", "i").collect()
    if not top:
        return {}
    wanted = docs.sparkSession.createDataFrame([(i,) for i in {r["i"] for r in top}], f"i {kind}")
    hashes = {r["h"] for r in top}

    def find(batches):
        for batch in (part for big in batches for part in slices(big, 0)):
            chunks = set()
            for text in as_bytes(batch.column(0)):
                stops, _ = encoder(tokenizer).parts(text)
                chunks.update(c for a, b in zip([0, *stops], stops, strict=False) if _hash(c := text[a:b]) in hashes)
            yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.binary())], names=["chunk"])

    def encode(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder(tokenizer).ids(batch.column(0).to_pylist()), pa.binary())], names=["chunk", "ids"])

    some = rows.join(F.broadcast(wanted), "i", "left_semi").select("t").mapInArrow(find, "chunk binary").distinct()
    return {bytes(r["chunk"]): bytes(r["ids"]) for r in some.mapInArrow(encode, "chunk binary, ids binary").collect()}  # SHARED of SHARED_BYTES at most


def _encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, make, kinds: list, schema: str) -> DataFrame:
    """Rows of id and make(ids, decoded text), of the Arrow types kinds."""
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, tokenizer, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *[x.split()[0] for x in schema.split(", ")]]

    def run(batches):
        bpe = encoder(tokenizer)
        for batch in (part for big in batches for part in slices(big, 1, 1_000_000)):
            out = [make(ids, bpe.plain(ids)) for ids in bpe.encode(as_bytes(batch.column(1)), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array of int), decoded (string).

    tokenizer is the path of a tokenizers file. A null text counts as empty: no ids, decoded is "".
    Repeated rows are encoded each (from the same chunks). Other columns are not read, whatever their
    names. An empty table gives an empty result. Texts are never truncated; what has no white space is one
    chunk. A tokenizer that doesn't split at white space encodes texts whole.
    """
    return _encoded(docs, tokenizer, id_col, text_col, lambda ids, text: (np.frombuffer(ids, "<i4"), text), [pa.list_(pa.int32()), pa.string()], "ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode(), but with n_tokens and SHA-256 of ids (little-endian, 4 bytes each) and decoded text in place of both, so ids never leave the worker."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    make = lambda ids, text: (len(ids) // 4, sha(ids), sha(text.encode()))
    return _encoded(docs, tokenizer, id_col, text_col, make, [pa.int64(), pa.string(), pa.string()], "n_tokens long, ids_sha256 string, decoded_sha256 string")
