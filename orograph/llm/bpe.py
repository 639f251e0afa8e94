r"""Byte-level BPE as a bounded-lookahead streaming transducer, and decoding by an incremental state machine.

Merging a piece of text from its left end, a token is stable once no byte further right can change it. What can change it
is a chain of merges of ever earlier rank that reaches leftwards from the right, so the merge list itself bounds how many bytes
to the right matter: ``sufficient_lookahead`` computes that number. A piece longer than the window is merged window by
window: tokens that end at least the lookahead before the window's end are emitted, and the window moves behind them. Memory is
that of a window (and of a bounded cache of short pieces) however long the text is. Decoding feeds token bytes to an incremental
UTF-8 decoder, which holds at most an unfinished character. ``round_trip`` feeds a text to both in slices and hashes tokens and
characters as they come, so beside the text itself a task holds a slice's tokens.

Defined results: a null text is the empty text and has no tokens. Equal texts have equal tokens. The special token's string
in a text is the special token, as the tokenizer file says. Bytes that are no UTF-8 decode to U+FFFD. An empty table gives
no rows. Extra columns are ignored.
"""

import codecs
import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, own_names

#: Fixed value: the pattern that cuts text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
RUNS = {"letters": r"\p{L}+", "numbers": r"\p{N}+", "others": r"[^\p{White_Space}\p{L}\p{N}]+", "spaces": r"\p{White_Space}+"}
PATTERN = regex.compile(PIECES)
RUN = {k: regex.compile(v) for k, v in RUNS.items()}
#: No alternative of the pattern looks further than this beyond its end to decide on a shorter match.
PEEK = 4


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Model:
    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]):
        letters = byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        self.special = special
        self.of_byte = [vocab[c] for c in letters]
        self.bytes = [b""] * (1 + max(*vocab.values(), *special.values(), 0))
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.lookahead = sufficient_lookahead(self)
        self.window = max(1024, 4 * self.lookahead)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    @classmethod
    def load(cls, path: str) -> "Model":
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        return cls(j["model"]["vocab"], j["model"]["merges"], {t["content"]: t["id"] for t in j.get("added_tokens", ()) if t["special"]})

    def merged(self, data: bytes) -> list[int]:
        """All merges over a window: the pair of lowest rank first, the leftmost of equal pairs first."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > 48:
            return self._merged_by_heap(ids)
        get = self.merge.get
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                m = get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merge.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, z = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = z, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if m := get((z, ids[k])):
                    heapq.heappush(heap, (m[0], i, z, ids[k], m[1]))
            if (h := left[i]) >= 0 and (m := get((ids[h], z))):
                heapq.heappush(heap, (m[0], h, ids[h], z, m[1]))
        return [x for x in ids if x >= 0]


def sufficient_lookahead(model: Model) -> int:
    """Bytes right of a token's end that can decide whether the token stands.

    reach[x] is how far right of a token x one must see to know, as of the merge rank reached so far, that x was formed
    and not taken by another merge. A merge (a, b) sees as far right of a as len(b) + reach[b]; a may be taken by it from
    then on, and the new token depends on what its right part did. Ranks only go down along such a chain, so one pass
    in the order of ranks computes it."""
    reach = [0] * len(model.bytes)
    for (a, b), (_, z) in sorted(model.merge.items(), key=lambda x: x[1][0]):
        sees = len(model.bytes[b]) + reach[b]
        reach[z] = max(reach[z], reach[b])
        reach[a] = max(reach[a], sees)
    return max(reach, default=0)


class Transducer:
    """Bytes of one piece in, stable tokens out."""

    def __init__(self, model: Model):
        self.model, self.held = model, b""

    def feed(self, data: bytes) -> list[int]:
        out, m, at = [], self.model, 0
        data = self.held + data
        while len(data) - at >= m.window:
            window = data[at : at + m.window]
            safe, end = len(window) - m.lookahead, 0
            for token in m.merged(window):
                if end + len(m.bytes[token]) > safe:
                    break
                end += len(m.bytes[token])
                out.append(token)
            at += end
        self.held = data[at:]
        return out

    def close(self) -> list[int]:
        held, self.held = self.held, b""
        return self.model.merged(held)


class Pieces(dict):
    """Tokens of short pieces, in two generations of ``most`` entries at most."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most, self.old = model, most, {}

    def __missing__(self, piece: str) -> tuple:
        found = self.old.get(piece)
        if found is None:
            t = Transducer(self.model)
            found = tuple(t.feed(piece.encode("utf-8", "surrogatepass"))) + tuple(t.close())
            if len(piece) > 64:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model)

    def encode(self, text: str) -> list[int]:
        """Tokens of a whole text."""
        get, special = self.pieces.__getitem__, self.model.special
        if self.model.cut is None or not any(s in text for s in special):
            return list(chain.from_iterable(map(get, PATTERN.findall(text))))
        out: list[int] = []
        for part in self.model.cut.split(text):
            if part in special:
                out.append(special[part])
            else:
                out += chain.from_iterable(map(get, PATTERN.findall(part)))
        return out

    def stream(self) -> "Stream":
        return Stream(self)


class Stream:
    """Encodes a text that comes in parts: feed() gives what is stable, close() the rest. Beside the parts themselves it
    holds a few characters and one window, also within a piece without end."""

    def __init__(self, encoder: Encoder):
        self.get, self.model = encoder.pieces.__getitem__, encoder.model
        self.text, self.run, self.transducer = "", None, None
        self.longest = max(map(len, self.model.special), default=1)

    def feed(self, part: str) -> list[int]:
        self.text += part
        out: list[int] = []
        while self.model.cut and any(s in self.text for s in self.model.special):
            m = self.model.cut.search(self.text)
            rest, self.text = self.text[m.end() :], self.text[: m.start()]
            out += self._advance(True)
            out.append(self.model.special[m[0]])
            self.text = rest
        # the start of a special token may be at the end of what is here
        held = next((k for k in range(min(self.longest - 1, len(self.text)), 0, -1) if any(s.startswith(self.text[-k:]) for s in self.model.special)), 0)
        tail, self.text = self.text[len(self.text) - held :], self.text[: len(self.text) - held]
        out += self._advance(False)
        self.text += tail
        return out

    def close(self) -> list[int]:
        return self._advance(True)

    def _advance(self, final: bool) -> list[int]:
        out: list[int] = []
        if self.run:
            out += self._continue(final)
            if self.run:
                return out
        pieces, at = PATTERN.findall(self.text), len(self.text)  # the pieces are the whole text
        if not final:
            safe = at - PEEK
            while pieces and at > safe:
                at -= len(pieces.pop())
        out += chain.from_iterable(map(self.get, pieces))
        self.text = self.text[at:]
        if not final and len(self.text) > self.model.window:
            first = self.text[1] if self.text[0] == " " and not self.text[1].isspace() else self.text[0]
            self.run = next(k for k, r in RUN.items() if r.match(first))
            self.transducer = Transducer(self.model)
            if first is not self.text[0] and self.run != "spaces":
                out += self.transducer.feed(b" ")
                self.text = self.text[1:]
            out += self._continue(False)
        return out

    def _continue(self, final: bool) -> list[int]:
        m = RUN[self.run].match(self.text)
        end = m.end() if m else 0
        open_ = end == len(self.text)
        if self.run == "spaces" and not (open_ and final):
            end = max(0, end - 1)  # the last space belongs to what follows
        out = self.transducer.feed(self.text[:end].encode("utf-8", "surrogatepass"))
        self.text = self.text[end:]
        if final or not open_:
            out += self.transducer.close()
            self.run = self.transducer = None
        return out


class Decoder:
    """Tokens in, text out as soon as its characters are whole."""

    def __init__(self, model: Model):
        self.of, self.state = model.bytes.__getitem__, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.of, ids)))

    def close(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """Kept by a Python worker for its later tasks."""
    return Encoder(Model.load(path))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the tokens of each row's text. path: a tokenizer file that every executor has."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([enc.encode(t or "") for t in rows.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``."""

    def run(batches):
        model = encoder(path).model
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows, texts = batch.slice(at, 64), []
                for ids in rows.column(1).to_pylist():
                    d = Decoder(model)
                    texts.append(d.feed(ids or ()) + d.close())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, keep=("doc_id",), text: str = "text", step: int = 1 << 14) -> DataFrame:
    """The columns ``keep``, ``n_tokens, ids_sha256, decoded_sha256``: streams each text through encoder and decoder, ``step`` characters at a time."""
    kept = docs.select(*keep)
    n = len(kept.columns)

    def run(batches):
        enc = encoder(path)
        number = [str(i) for i in range(len(enc.model.bytes))].__getitem__

        def one(value: str):
            stream, decoder, ids_sha, text_sha, count = enc.stream(), Decoder(enc.model), hashlib.sha256(), hashlib.sha256(), 0
            for at in range(0, len(value) + 1, step):
                part = stream.feed(value[at : at + step])
                if at + step > len(value):
                    part += stream.close()
                if part:
                    ids_sha.update((("," if count else "") + ",".join(map(number, part))).encode())
                    text_sha.update(decoder.feed(part).encode())
                    count += len(part)
            text_sha.update(decoder.close().encode())
            return count, ids_sha.hexdigest(), text_sha.hexdigest()

        for batch in batches:
            found = [one(value.as_py() or "") for value in batch.column(n)]
            counts, ids_sha, text_sha = ([x[i] for x in found] for i in range(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [*batch.schema.names[:n], "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema) + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(*keep, F.col(text).alias(own_names(kept.columns, "text_of")[0]))
    return materialise(rows.mapInArrow(run, schema), "round-trip")
