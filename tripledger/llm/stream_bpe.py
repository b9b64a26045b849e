"""BPE encoding and decoding as bounded-lookahead streaming transducers.

A text is read in pieces of bounded size and passes through a chain of small machines, each of which holds back only what a later
character could still change: special strings, the normal form, pre-tokens, merges. None holds more than a constant, whatever the
length of a text or of a word in it (but for a run of combining marks, which the normal form has to see whole).

Merges. Let the tokens of a word's first i symbols be known. Symbols appended to it can change them only through a chain of merges
that begins at the end and moves left: a merge over the end takes a symbol that a later merge would have taken as its right part,
which frees or binds the left part of that one, and so on, each merge later in the list than the one before. ``lookahead`` is the
length of the longest such chain, computed from the list; tokens that end further left than that are stable and leave. What is
not stable yet is a stack of tokens: the longest match is put on it if it is compatible with the token below (the two stay apart when their
symbols are merged by themselves), else the next shorter one, else the stack gives one back. Neighbours that are all compatible are
the tokens that the merge list makes.

Decoding looks ids up one after the other and gives text out as soon as its bytes are whole.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.blocks import gathered
from tripledger.llm.common import lean

#: Characters read at a time; a word of more than LONG is not kept but fed to the merges as it comes; words a task remembers.
PIECE, LONG, KNOWN = 1 << 16, 256, 1 << 18
#: A word's end, as a symbol after its last character; it is no character of the byte alphabet.
END = "\0"
NEVER = 1 << 60


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible in Latin-1, else the next one from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(256 + hidden.index(b)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """How many symbols left of a word's known end its tokens can still change, over all continuations.

    A chain's next merge has as its right part what the one before left there: its left part, or what it made.
    """
    furthest: dict[str, int] = {}
    longest = 0
    for left, right in reversed(merges):  # the latest merge of a chain first
        reach = size(left) + max(furthest.get(left, 0), furthest.get(left + right, 0))
        furthest[right] = max(furthest.get(right, 0), reach)
        longest = max(longest, reach)
    return longest


def size(token: str) -> int:
    return len(token.rstrip(END))


class Merges:
    """A merge list whose tokens are each made by one merge of parts that earlier merges make; any other is refused."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = vocab
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in merges}
        self.born = {a + b: r for r, (a, b) in enumerate(merges)}
        if len(self.parts) != len(merges):
            raise ValueError("two merges make the same token")
        for token, (a, b) in self.parts.items():
            if token not in vocab or any(size(p) > 1 and self.born.get(p, NEVER) >= self.born[token] for p in (a, b)):
                raise ValueError(f"the merge of {a!r} and {b!r} comes before its parts")
        self.lookahead, self.longest = lookahead(merges), max(map(size, vocab))
        self.left_spine, self.right_spine = {t: self._spine(t, 0) for t in vocab}, {t: self._spine(t, 1) for t in vocab}
        shorter: dict[str, str | None] = {}
        for t in vocab:
            shorter[t] = next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in vocab), None)
        self.shorter = shorter
        self.beginnings = {t[:n] for t in vocab for n in range(1, len(t) + 1)}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _spine(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """The parts that stood at one edge of a token while it was made, the latest first: part, when it was made, when it was merged away."""
        out, dies = [], NEVER
        while True:
            born = self.born.get(token, -1)
            out.append((token, born, dies))
            if born < 0:
                return out
            token, dies = self.parts[token][side], born

    def longest_at(self, text: str, at: int) -> str | None:
        n, found = 1, 0
        while (beginning := text[at : at + n]) in self.beginnings and at + n <= len(text):
            if beginning in self.ids:
                found = n
            n += 1
        return text[at : at + found] or None

    def compatible(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > KNOWN:
                self.pairs.clear()
            found = self.pairs[a, b] = self._stay_apart(a, b)
        return found

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether no merge joins the edges of a and b while they are made: going back in time, the part made later gives way to its own parts."""
        right, left = self.right_spine[a], self.left_spine[b]
        i = k = 0
        while True:
            x, made, x_dies = right[i]
            y, y_made, y_dies = left[k]
            r = self.rank.get((x, y), NEVER)
            if r < x_dies and r <= y_dies:  # of two equal merges side by side, the left one comes first
                return False
            if made < 0 and y_made < 0:
                return True
            if made > y_made:
                i += 1
            else:
                k += 1


class Word:
    """The transducer of one word: feed() gives the tokens that have become stable, finish() the rest."""

    def __init__(self, merges: Merges):
        self.m, self.text, self.at, self.stack, self.settled = merges, "", 0, [], False
        self.dead: set[int] = set()  # places in the text held that no tokens lead on from

    def feed(self, symbols: str) -> list[str]:
        self.text += symbols
        self._advance(len(self.text) - self.m.longest)  # so that a longest match is seen whole
        stable = n = 0
        while n < len(self.stack) and stable + len(self.stack[n]) <= self.at - self.m.lookahead:
            stable += len(self.stack[n])
            n += 1
        if n < 2:
            return []
        # The last stable token stays, as the neighbour that the next one must be compatible with.
        out, self.stack, self.settled = self.stack[: n - 1], self.stack[n - 1 :], True
        cut = sum(map(len, out))
        self.text, self.at, self.dead = self.text[cut:], self.at - cut, {d - cut for d in self.dead if d >= cut}
        return out

    def finish(self) -> list[str]:
        self.text += END
        self._advance(len(self.text))
        return self.stack

    def _advance(self, upto: int) -> None:
        """Puts tokens on the stack while the next one begins before upto."""
        text, stack, dead, shorter, compatible, longest_at = self.text, self.stack, self.dead, self.m.shorter, self.m.compatible, self.m.longest_at
        at = self.at
        token = longest_at(text, at) if at < upto else None
        while at < upto:
            while token and (at + len(token) in dead or (stack and not compatible(stack[-1], token))):
                token = shorter[token]
            if token:
                stack.append(token)
                at += len(token)
                token = longest_at(text, at) if at < upto else None
                continue
            dead.add(at)
            if len(stack) == self.settled:
                raise ValueError(f"no tokens for {self.text!r}")
            token = stack.pop()
            at -= len(token)
            token = shorter[token]
        self.at = at


class Encoder:
    """Ids of texts by a tokenizer file: special strings, normal form and lower case, words by a pattern, byte-level merges with word ends."""

    def __init__(self, content: bytes):
        import regex

        file = json.loads(content)
        model, normal, words = file["model"], file["normalizer"], file["pre_tokenizer"]
        suffix = model.get("end_of_word_suffix")
        kinds = [n["type"] for n in normal["normalizers"]], [w["type"] for w in words["pretokenizers"]]
        split = words["pretokenizers"][0]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or not suffix or not split["invert"] or split["behavior"] != "Removed" or file["decoder"] or model["dropout"]:
            raise ValueError("a tokenizer file of another kind")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError("added tokens of another kind")
        own = lambda token: token.removesuffix(suffix) + END if token.endswith(suffix) else token
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges({own(t): i for t, i in model["vocab"].items()}, [(own(a), own(b)) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.find_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        # The pattern takes runs of one kind, which may go on in the next piece, and short matches, which begin with one of them.
        self.words = regex.compile(split["pattern"]["Regex"])
        self.runs = [regex.compile(r"\p{L}+"), regex.compile(r"[^\s\p{L}\p{N}]+")]
        self.last_space = regex.compile(r"(?r)\s")  # from the end backwards
        self.alphabet = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.known = Known(self)
        tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        back = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        whole = {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [whole[i] if i in whole else b"".join(back[c] for c in t.removesuffix(suffix)) + (b" " if t.endswith(suffix) else b"") for i, t in enumerate(self.tokens)]

    def symbols(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.alphabet)

    def packed(self, tokens: list[str]) -> bytes:
        return array("I", [self.merges.ids[t] for t in tokens]).tobytes()

    def whole_word(self, word: str) -> bytes:
        machine = Word(self.merges)
        machine.text = self.symbols(word)
        return self.packed(machine.finish())

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as 32-bit numbers, in pieces."""
        at = 0
        if any(s in text for s in self.special):
            for found in self.find_special.finditer(text):
                yield from self._segment(text, at, found.start())
                yield array("I", [self.special[found.group()]]).tobytes()
                at = found.end()
        yield from self._segment(text, at, len(text))

    def _segment(self, text: str, at: int, end: int) -> Iterator[bytes]:
        rest, machine, run = "", None, None
        while at < end:
            upto = cut_before(text, at, min(at + PIECE, end), end)
            piece, at = normal_form(text[at:upto]), upto
            self.known.age()
            if machine is not None:
                n = run.match(piece).end() if run.match(piece) else 0
                yield self.packed(machine.feed(self.symbols(piece[:n])))
                if n == len(piece) and at < end:
                    continue
                yield self.packed(machine.finish())
                machine, piece = None, piece[n:]
            piece = rest + piece
            if at == end:
                yield self._all(self.words.findall(piece))
                return
            space = self.last_space.search(piece)
            open_from = space.end() if space else 0
            yield self._all(self.words.findall(piece[:open_from]))
            rest = piece[open_from:]
            if len(rest) > LONG:
                done = 0
                for found in self.words.finditer(rest):
                    if found.end() > len(rest) - 2 and not (len(found.group()) > 3 and found.end() < len(rest)):
                        break  # what follows could still change it
                    yield self._all([found.group()])
                    done = found.end()
                rest = rest[done:]
                run = next((r for r in self.runs if (m := r.match(rest)) and m.end() == len(rest)), None)
                if len(rest) > LONG and run is not None:
                    machine = Word(self.merges)
                    yield self.packed(machine.feed(self.symbols(rest)))
                    rest = ""

    def _all(self, words: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


class Known(dict):
    """Ids of words by word; long ones are not kept. When it is full, what was not used since it was full before goes."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.before = encoder, {}

    def age(self) -> None:
        if len(self) > KNOWN:
            self.before = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONG:
            machine, out = Word(self.encoder.merges), []
            for i in range(0, len(word), LONG):
                out.append(self.encoder.packed(machine.feed(self.encoder.symbols(word[i : i + LONG]))))
            return b"".join([*out, self.encoder.packed(machine.finish())])
        found = self.before.get(word)
        if found is None:
            found = self.encoder.whole_word(word)
        self[word] = found
        return found


def normal_form(text: str) -> str:
    """NFC, then each character in lower case by itself: a sigma at a word's end is no exception."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def cut_before(text: str, at: int, upto: int, end: int) -> int:
    """A place near upto where the normal forms of both sides make that of the whole: not before a mark, nor before a vowel or final consonant of Hangul."""
    joins = lambda c: unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff"
    back = upto
    while at < back < end and joins(text[back]):
        back -= 1
    if back > at:
        return back
    while upto < end and joins(text[upto]):
        upto += 1
    return upto


class Decoder:
    """Text of ids, given in pieces: bytes wait until their character is whole.

    As the library does for a file without a decoder, tokens are joined by spaces as they are written in the vocabulary; with text, they are
    the bytes that they stand for, a space where a word ends.
    """

    def __init__(self, table: tuple[np.ndarray, np.ndarray], text: bool = False):
        self.values, self.starts = table
        self.first, self.text = True, text
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    @staticmethod
    def table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def feed(self, ids: np.ndarray) -> str:
        raw = gathered(self.values, self.starts, ids.astype(np.int64)).tobytes()
        if raw and self.first and not self.text:
            raw = raw[1:]
        self.first = self.first and not raw
        return self.utf8.decode(raw)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


@functools.lru_cache(2)
def machines(content: bytes) -> tuple[Encoder, tuple, tuple]:
    """The encoder, and the tables of tokens as the library writes them, a space before each, and as bytes; made once for each worker."""
    encoder = Encoder(content)
    return encoder, Decoder.table([b" " + t.encode() for t in encoder.tokens]), Decoder.table(encoder.bytes_of)


def stream_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded", "text")) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and those of ids (array<int>), decoded and text (strings) that ``outputs`` names.

    decoded is the library's: tokens joined by spaces, word ends visible. text is what the tokens stand for, a space after each word.
    A null text counts as empty and has no ids. Null and repeated identifiers pass through, a row each; an empty input gives an
    empty result; other columns play no part. Characters that Unicode has had since version 16 only may be of another kind to Python's tables
    than to the library's. No shuffle: a text is read once, in pieces, and only digests are kept unless outputs asks for more.
    """
    with open(path or vocabulary_path(), "rb") as file:  # executors need not have the file
        content = file.read()
    Encoder(content)  # refuses other files here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, written, plain = machines(content)
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in schema.names}
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, ids_digest, decoded_digest = 0, hashlib.sha256(), hashlib.sha256()
                as_written, as_text = Decoder(written), Decoder(plain, text=True)
                kept: dict[str, list] = {name: [] for name in outputs}
                for raw in encoder.encode(value.as_py() or ""):
                    ids = np.frombuffer(raw, "<u4")
                    n += len(ids)
                    ids_digest.update(raw)
                    decoded = as_written.feed(ids)
                    decoded_digest.update(decoded.encode())
                    if outputs:
                        now = {"ids": ids, "decoded": decoded, "text": as_text.feed(ids) if "text" in outputs else None}
                        for name in outputs:
                            kept[name].append(now[name])
                rows["doc_id"].append(key)
                rows["n_tokens"].append(n)
                rows["ids_sha256"].append(ids_digest.hexdigest())
                rows["decoded_sha256"].append(decoded_digest.hexdigest())
                for name in outputs:
                    rows[name].append(np.concatenate([np.empty(0, "<u4"), *kept[name]]).astype(np.int32) if name == "ids" else "".join([*kept[name], as_text.finish() if name == "text" else ""]))
            yield pa.RecordBatch.from_pydict(rows, schema)

    types = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "text": pa.string()}
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *((name, types[name]) for name in outputs)])
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {name} {'array<int>' if name == 'ids' else 'string'}" for name in outputs)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), ddl)


def decoded_ids(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and text of rows of ids, as ``text`` of stream_bpe; null ids give a null text, ids outside the vocabulary an error."""
    with open(path or vocabulary_path(), "rb") as file:
        content = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = machines(content)[2]
        for batch in batches:
            texts = []
            for value in batch.column(1):
                if not value.is_valid:
                    texts.append(None)
                    continue
                ids, machine = value.values.to_numpy(zero_copy_only=False), Decoder(plain, text=True)
                if len(ids) and (ids.min() < 0 or ids.max() + 1 >= len(plain[1])):
                    raise ValueError("an id outside the vocabulary")
                texts.append("".join(machine.feed(ids[i : i + PIECE]) for i in range(0, len(ids), PIECE)) + machine.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(lean(run), "doc_id bigint, text string")


def op11(spark, sf_dir: str) -> DataFrame:
    from tripledger.llm.common import table

    return stream_bpe(table(spark, sf_dir, "documents"), outputs=())
