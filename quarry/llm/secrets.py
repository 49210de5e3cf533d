"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find assignments to telling names, access keys and long hex
strings. A field over the tokens of a text tags each as beginning of a
secret, inside or outside. It sees the shape of a token and of its
neighbours, the words around it and how dense the file is with digits and
signs, and is trained on windows around the patterns' matches and elsewhere.
Some of these have their secret rewritten in other alphabets, or their name
exchanged, so the field learns more than the patterns say.

Decoding is Viterbi's. A token whose margin for outside is greater than all
that transitions could make good is outside on every best path; chains are
cut there, so only the short stretches in between are decoded step by step.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import wordhash

#: Kinds in the order of the contract, with pattern and the code points a match (of an assignment: its value) has at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
KINDS = ("assign", "access", "hex", "secret")
#: One pattern that is found in every text with a match.
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}"""

#: Windows of each sort that are learned from at most, documents they come from about, and code points around a match.
SAMPLE, CHOSEN_DOCS, AROUND = 1000, 100_000, 160
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.2, 1e-4
#: Bytes of a secret of the field's own at least; bytes decoded at once, and around them where a long text is cut.
SECRET_BYTES, PIECE, MARGIN = 8, 1 << 20, 1 << 12
OUT, BEGIN, INSIDE = range(3)
#: Names that stand in for the known ones in windows to learn from.
_NAMES = ("credential", "passphrase", "auth", "private_key", "access_key", "pwd")
_NAMED = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?$""", re.A | re.I)
_JOINTS = ("=", ": ", " = ", ' = "', ': "', ":", "='", " ")
_ALPHABETS = ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
              "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789....", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")

_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOW = (_BYTES >= 97) & (_BYTES <= 122)
_SIGN = np.isin(_BYTES, list(b"+/_-"))
_WIDE = _BYTES >= 128
_HEXED = _DIGIT | ((_BYTES >= 97) & (_BYTES <= 102)) | ((_BYTES >= 65) & (_BYTES <= 70))
_WHITE = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])
_IN_WORD = _DIGIT | _UPPER | _LOW | _SIGN | _WIDE
_MARK = np.isin(_BYTES, list(b"=:\"'{}();_<>"))
_SORT = np.select([_DIGIT, _UPPER | _LOW | _WIDE], [1, 2], 0).astype(np.int8)
#: What a token holds, as bits: small and large letters, digits, signs, bytes outside ASCII, anything but hex digits.
_HELD = (_LOW * 1 + _UPPER * 2 + _DIGIT * 4 + _SIGN * 8 + _WIDE * 16 + (~_HEXED & ~_WHITE) * 32).astype(np.uint8)
_LENGTH = np.searchsorted([2, 3, 5, 7, 10, 15, 19, 23, 31, 47, 64], np.arange(66), side="right").astype(np.int32)
_TURNS = np.searchsorted([1, 3, 8], np.arange(9), side="right").astype(np.int32)
_LOWER = wordhash.ascii_lower_table()

SHAPES, WORDS, LENGTHS = 12 * 64 * 4, 1 << 12, 12
#: Sizes of the feature groups: three shapes, five words, mixture, two of the file with length and sort, constant.
_GROUPS = [SHAPES] * 3 + [WORDS] * 5 + [LENGTHS * 4 * 5, LENGTHS * 5 * 2, LENGTHS * 5 * 2, 1]
_BASE = np.concatenate([[0], np.cumsum(_GROUPS)])
N_FEATURES = int(_BASE[-1])


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of the patterns' matches, by start and kind."""
    found = [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def file_features(data: np.ndarray) -> tuple[int, int]:
    """How dense a text is with digits and with signs, in five steps each."""
    n = max(len(data), 1)
    return tuple(int(np.searchsorted([0.002, 0.01, 0.05, 0.2], seen[data].sum() / n)) for seen in (_DIGIT, _MARK))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends: runs of letters, digits, ``+/_-`` and bytes outside ASCII; each other byte but white space alone."""
    word, cut = _IN_WORD[data], np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = ~_WHITE[data]
    first[1:] &= ~(word[1:] & word[:-1]) | cut[1:-1]
    last = ~_WHITE[data]
    last[:-1] &= ~(word[1:] & word[:-1]) | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _moved(values: np.ndarray, row: np.ndarray, by: int, none: int) -> np.ndarray:
    """What stands ``by`` tokens before (or after) in the same text."""
    out = np.full(len(values), none, values.dtype)
    if by > 0:
        same = row[by:] == row[:-by]
        out[by:][same] = values[:-by][same]
    else:
        same = row[:by] == row[-by:]
        out[:by][same] = values[-by:][same]
    return out


def features(data: np.ndarray, offsets: np.ndarray, files: np.ndarray):
    """Row, start and end of each token, and for each group of features the tokens' places in the weights."""
    starts, ends = tokens(data, offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    if not len(starts):
        return row, starts, ends, [np.zeros(0, np.int32)] * len(_GROUPS)
    # what lies between two starts is a token and white space, which counts for nothing
    held = np.bitwise_or.reduceat(_HELD[data], starts)
    digit = np.add.reduceat(_DIGIT[data].view(np.uint8), starts, dtype=np.int32)
    sort, word = _SORT[data], _IN_WORD[data]
    turn = np.zeros(len(data), np.uint8)
    turn[1:] = (sort[1:] != sort[:-1]) & word[1:] & word[:-1]
    turned = _TURNS[np.minimum(np.add.reduceat(turn, starts, dtype=np.int32), 8)]
    size = (ends - starts).astype(np.int32)
    length = _LENGTH[np.minimum(size, 65)]
    shape = (length * 64 + held) * 4 + turned
    hashes = wordhash.SpanHasher(_LOWER[data]).spans(starts, ends)
    word = np.where(size <= 16, 1 + (hashes % np.uint64(WORDS - 2)).astype(np.int32), np.int32(WORDS - 1))
    # the last word before, signs left out
    is_word = _IN_WORD[data[starts]]
    latest = np.maximum.accumulate(np.where(is_word, np.arange(len(starts)), -1))
    before = np.concatenate([[-1], latest[:-1]])
    name = np.where((before >= 0) & (row[before] == row) & (np.arange(len(starts)) - before <= 5), word[before], 0)
    mixture = (length * 4 + turned) * 5 + np.minimum(5 * digit // size, 4)
    some_digit = digit > 0
    files = files.astype(np.int32)
    columns = [shape, _moved(shape, row, 1, 0), _moved(shape, row, -1, 0), word, _moved(word, row, 1, 0), _moved(word, row, 2, 0),
               _moved(word, row, -1, 0), name, mixture, (length * 5 + files[row, 0]) * 2 + some_digit,
               (length * 5 + files[row, 1]) * 2 + some_digit, np.zeros(len(row), np.int32)]
    return row, starts, ends, [c + np.int32(b) for c, b in zip(columns, _BASE)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Field:
    """Weights of features by label, and of transitions (from, to); a chain begins as if after an outside token."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, found: list[np.ndarray]) -> np.ndarray:
        return sum(self.weights[places] for places in found)

    def margin(self, found: list[np.ndarray]) -> np.ndarray:
        """How far outside is ahead of the better of the other labels."""
        w = self.weights
        # both margins as one complex number: one look-up for each feature
        pairs = ((w[:, OUT] - w[:, BEGIN]) + 1j * (w[:, OUT] - w[:, INSIDE])).astype(np.complex64)
        total = np.take(pairs, found[0])
        for places in found[1:]:
            total += np.take(pairs, places)
        return np.minimum(total.real, total.imag)

    @property
    def reach(self) -> float:
        """The most that transitions can make good for a label other than outside."""
        m = self.moves
        return max(float(m[a, y] + m[y, b] - m[a, OUT] - m[OUT, b]) for y in (BEGIN, INSIDE) for a in range(3) for b in range(3))

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best labels of chains (chain, step, label), all of one length, each followed by an outside token or the end."""
        n, steps, _ = scores.shape
        back = np.zeros((n, steps, 3), np.int8)
        at = scores[:, 0] + self.moves[OUT]
        for t in range(1, steps):
            ways = at[:, :, None] + self.moves[None]
            back[:, t] = ways.argmax(axis=1)
            at = ways.max(axis=1) + scores[:, t]
        labels = np.zeros((n, steps), np.int8)
        labels[:, -1] = (at + self.moves[:, OUT]).argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            labels[:, t - 1] = back[np.arange(n), t, labels[:, t]]
        return labels

    def decode(self, found: list[np.ndarray], row: np.ndarray) -> np.ndarray:
        """Labels of all tokens; every text is a chain of its own."""
        labels = np.zeros(len(row), np.int8)
        # a little more than the reach: margins are summed in single precision
        open_ = np.flatnonzero(self.margin(found) <= self.reach + 1e-3)
        if not len(open_):
            return labels
        scores = self.emissions([places[open_] for places in found])
        breaks = np.flatnonzero((np.diff(open_) > 1) | (row[open_[1:]] != row[open_[:-1]])) + 1
        first = open_[np.concatenate([[0], breaks])]
        size = np.diff(np.concatenate([[0], breaks, [len(open_)]]))
        place = np.concatenate([[0], breaks])
        for n in np.unique(size):
            step = np.arange(n)
            labels[first[size == n][:, None] + step] = self.viterbi(scores[place[size == n][:, None] + step])
        return labels

    def gradient(self, found: np.ndarray, truth: np.ndarray, sizes: np.ndarray):
        """Of the log likelihood of padded chains (chain, step, feature), by emission (chain, step, label) and transition."""
        n, steps = truth.shape
        scores = np.zeros((n, steps, 3))
        for k in range(found.shape[2]):
            scores += self.weights[found[:, :, k]]
        inside = np.arange(steps) < sizes[:, None]
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0] + self.moves[OUT]
        for t in range(1, steps):
            ahead[:, t] = np.where(inside[:, t, None], _log_sum(ahead[:, t - 1, :, None] + self.moves, 1) + scores[:, t],
                                   ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            step = _log_sum(self.moves[None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(inside[:, t + 1, None], step, 0)
        total = _log_sum(ahead[:, -1], 1)[:, None, None]
        own = np.exp(ahead + behind - total)
        hot = np.eye(3)[truth]
        by_token = np.where(inside[:, :, None], hot - own, 0)
        both = np.exp(ahead[:, :-1, :, None] + self.moves + (scores + behind)[:, 1:, None, :] - total[..., None])
        seen = hot[:, :-1, :, None] * hot[:, 1:, None, :]
        by_move = np.where(inside[:, 1:, None, None], seen - both, 0).sum(axis=(0, 1))
        by_move[OUT] += by_token[:, 0].sum(axis=0)
        return by_token, by_move


def train(examples: list[tuple[bytes, tuple[int, int], list[tuple[int, int]]]], seed: int = 5) -> Field:
    """A field from (text, file features, byte spans of secrets)."""
    field = Field(np.zeros((N_FEATURES + 1, 3)), np.zeros((3, 3)))
    field.weights[_BASE[-2], OUT] = 1.0
    chains = []
    for text, files, spans in examples:
        data = np.frombuffer(text, np.uint8)
        _, starts, ends, found = features(data, np.array([0, len(data)]), np.array([files]))
        truth = np.zeros(len(starts), np.int8)
        for a, b in spans:
            own = np.flatnonzero((starts >= a) & (ends <= b))
            truth[own] = INSIDE
            truth[own[:1]] = BEGIN
        if len(starts):
            chains.append((np.stack(found, axis=1), truth))
    chains.sort(key=lambda c: len(c[1]))
    rng = np.random.default_rng(seed)
    seen_w, seen_m = np.full_like(field.weights, 1e-6), np.full_like(field.moves, 1e-6)
    batches = [chains[a:a + BATCH] for a in range(0, len(chains), BATCH)]
    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            sizes = np.array([len(t) for _, t in batches[b]])
            found = np.full((len(sizes), sizes.max(), len(_GROUPS)), N_FEATURES, np.int32)
            truth = np.zeros(found.shape[:2], np.int8)
            for k, (f, t) in enumerate(batches[b]):
                found[k, :len(t)], truth[k, :len(t)] = f, t
            by_token, by_move = field.gradient(found, truth, sizes)
            places, which = np.unique(found.reshape(-1), return_inverse=True)
            grad = np.stack([np.bincount(which, np.repeat(by_token[:, :, c].reshape(-1), len(_GROUPS)), len(places))
                             for c in range(3)], axis=1) / len(sizes) - DECAY * field.weights[places]
            seen_w[places] += grad ** 2
            field.weights[places] += RATE * grad / np.sqrt(seen_w[places])
            by_move = by_move / len(sizes) - DECAY * field.moves
            seen_m += by_move ** 2
            field.moves += RATE * by_move / np.sqrt(seen_m)
            field.weights[N_FEATURES] = 0
    return field


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text a window around one match, if it has any, and one that starts at a hashed place."""
    for batch in batches:
        out = []
        likely = pc.match_substring_regex(batch.column(0), _ANY).to_pylist()
        for text, may in zip(batch.column(0).to_pylist(), likely):
            digest = hashlib.blake2b(text.encode(), digest_size=8).digest()
            at = int.from_bytes(digest, "little")
            files = file_features(np.frombuffer(text.encode(), np.uint8))
            found = base_spans(text) if may else []
            if found:
                start, end, _, _ = found[at % len(found)]
                out.append((True, text[max(0, start - AROUND):min(end, start + 4 * AROUND) + AROUND], *files))
            place = at % max(1, len(text) - 2 * AROUND)
            out.append((False, text[place:place + 2 * AROUND], *files))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.bool_(), pa.string(), pa.int32(), pa.int32()))],
            ["around_match", "text", "digits", "signs"])


def _values(text: str) -> list[tuple[int, int]]:
    """The secrets' own code points, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for _, end, _, start in sorted(base_spans(text), key=lambda s: s[3]):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _in_bytes(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans]


def _examples(rows: list, seed: int = 3) -> list:
    """The windows as they are, and those around a match also with other secrets and names."""
    rng = np.random.default_rng(seed)
    out = []
    for r in rows:
        files, spans = (r.digits, r.signs), _values(r.text)
        out.append((r.text.encode(), files, _in_bytes(r.text, spans)))
        if not r.around_match:
            continue
        for alphabet in _ALPHABETS:
            text, moved, at = "", [], 0
            for a, b in spans:
                before = _NAMED.sub("", r.text[at:a])
                if before != r.text[at:a]:
                    before += _NAMES[int(rng.integers(len(_NAMES)))] + _JOINTS[int(rng.integers(len(_JOINTS)))]
                value = "".join(alphabet[int(i)] for i in rng.integers(len(alphabet), size=int(rng.integers(14, 48))))
                text += before + value
                moved.append((len(text) - len(value), len(text)))
                at = b
            text += r.text[at:]
            out.append((text.encode(), files, _in_bytes(text, moved)))
    return out


def learn(docs: DataFrame, text: str = "text") -> Field | None:
    """A field from at most ``SAMPLE`` windows of each sort, of about ``CHOSEN_DOCS`` documents chosen by a hash."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(text).alias("text")).filter("text IS NOT NULL AND text <> ''")
    n = texts.count()
    share = min(1.0, CHOSEN_DOCS / max(n, 1))
    chosen = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    windows = chosen.mapInArrow(_windows, "around_match boolean, text string, digits int, signs int").distinct()
    order = [F.xxhash64("text", F.lit(1)), F.col("text"), F.col("digits"), F.col("signs")]
    rows = [r for sort in (True, False) for r in windows.filter(F.col("around_match") == sort).orderBy(*order).limit(SAMPLE).collect()]
    if not any(r.around_match for r in rows):
        return None
    return train(_examples(rows))


def _pieces(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, with margin from, to): a long text cut at white space where there is any."""
    at = lo
    while at < hi:
        end = min(at + PIECE, hi)
        if end < hi:
            gap = np.flatnonzero(_WHITE[data[end:min(end + MARGIN, hi)]])
            end += int(gap[0]) if len(gap) else 0
        yield at, end, max(lo, at - MARGIN), min(hi, end + MARGIN)
        at = end


def _tagged(field: Field, data: np.ndarray, offsets: np.ndarray, files: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of runs of tokens tagged as a secret; white space and a beginning end a run."""
    row, starts, ends, found = features(data, offsets, files)
    labels = field.decode(found, row)
    held = np.flatnonzero(labels != OUT)
    if not len(held):
        return []
    new = np.ones(len(held), bool)
    new[1:] = (np.diff(held) > 1) | (row[held[1:]] != row[held[:-1]]) | (labels[held[1:]] == BEGIN) \
        | (starts[held[1:]] != ends[held[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(held)) - 1
    a, b = starts[held[first]], ends[held[last]]
    return [(int(r), int(x), int(y)) for r, x, y in zip(row[held[first]], a, b) if y - x >= SECRET_BYTES]


def found_by_field(field: Field, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Byte spans within each row that the field tags."""
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in wordhash.row_slices(offsets, PIECE):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= PIECE:
            part, bounds = data[lo:hi], offsets[a:b + 1] - lo
            counts = [np.concatenate([[0], np.cumsum(seen[part], dtype=np.int64)]) for seen in (_DIGIT, _MARK)]
            share = [np.diff(c[bounds]) / np.maximum(np.diff(bounds), 1) for c in counts]
            files = np.stack([np.searchsorted([0.002, 0.01, 0.05, 0.2], s) for s in share], axis=1)
            for r, x, y in _tagged(field, part, bounds, files):
                out.setdefault(a + r, []).append((x - int(bounds[r]), y - int(bounds[r])))
            continue
        files = np.array([file_features(data[lo:hi])])
        for start, end, low, high in _pieces(data, lo, hi):
            for _, x, y in _tagged(field, data[low:high], np.array([0, high - low]), files):
                if start <= low + x < end:
                    out.setdefault(a, []).append((low + x - lo, low + y - lo))
    return out


def _scan(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).fill_null("")
            likely = pc.match_substring_regex(column, _ANY).to_numpy(zero_copy_only=False)
            data, offsets = wordhash.buffers(column)
            tagged = found_by_field(field, data, offsets) if field else {}
            spans = []
            for k in range(batch.num_rows):
                if not likely[k] and k not in tagged:
                    spans.append([])
                    continue
                text = column[k].as_py()
                base = [(a, b, kind) for a, b, kind, _ in base_spans(text)] if likely[k] else []
                raw = data[offsets[k]:offsets[k + 1]]
                for x, y in tagged.get(k, []):
                    a = int((raw[:x] & 0xC0 != 0x80).sum())
                    b = a + int((raw[x:y] & 0xC0 != 0x80).sum())
                    # the patterns' spans stay as they are; one of the field may not touch them
                    if all(b <= s or a >= e for s, e, _ in base):
                        base.append((a, b, "secret"))
                spans.append(sorted(base, key=lambda s: (s[0], KINDS.index(s[2]))))
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in spans], kinds)],
                ["doc_id", "found"])
    return run


def find_secrets(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, found (array of kind, start, end, in code points, by start and kind).

    ``assign``, ``access`` and ``hex`` are the patterns' matches, ``secret``
    what ``field`` tags apart from them. Null and empty texts hold nothing;
    repeated rows are scanned each; ids are only passed on (they may be
    null), other columns not read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
        _scan(field), f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def secrets_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_secret of each row, with a field learned from ``docs``.

    ``spans`` lists kind:start:end of all, comma-joined, ``base_sha256`` is
    the digest of the list of the patterns' matches only. Where no text has
    a match there is nothing to learn from, and the patterns stand alone.
    Otherwise as in ``find_secrets``.
    """
    found = find_secrets(docs, learn(docs, text), text)
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("found", lambda s: s["kind"] != "secret")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(said(base), 256).alias("base_sha256"),
                        said(F.col("found")).alias("spans"), count("secret").alias("n_secret"))
