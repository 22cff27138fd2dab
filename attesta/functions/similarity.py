"""The Python helpers: text similarity, the closest window of a long text, zip listing.

All get Arrow batches and are only fed what plain expressions could not decide: the caller passes
null for every other row. They are declared non-deterministic, though they are not, so that the
optimizer neither repeats them nor moves filters on their results below joins and aggregates.
"""

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: Letters of a piece of a value searched for at once, of a stretch of text, and of all stretches scanned together.
_PIECE, _STRETCH, _TOGETHER = 60, 256, 1 << 20

_REGIONS = ArrayType(StructType([StructField("start", IntegerType()), StructField("part", StringType())]))
_WINDOW = StructType([StructField("ratio", DoubleType()), StructField("matched", StringType())])


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, null when either is null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio()
                      if x is not None and y is not None else None
                      for x, y in zip(a, b, strict=True)], dtype="float64")


similarity = _similarity.asNondeterministic()


def _shared_letters(needle: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """For every window of ``size``: how many letters it shares with the needle at most."""
    shared = np.zeros(len(text) - size + 1, dtype=np.int32)
    for symbol in np.unique(needle):
        seen = np.concatenate(([0], np.cumsum(text == symbol, dtype=np.int32)))
        shared += np.minimum(seen[size:] - seen[:-size], int((needle == symbol).sum()))
    return shared


def _least_edits(needle: str, text: str) -> np.ndarray:
    """For every end in the text: the fewest edits that turn the needle into some piece of text
    ending there (Myers' bit-vector scan, one step per letter whatever the needle's length)."""
    n = len(needle)
    full, top = (1 << n) - 1, 1 << (n - 1)
    at = dict.fromkeys(text, 0)
    for i, letter in enumerate(needle):
        if letter in at:
            at[letter] |= 1 << i
    plus, minus, edits = full, 0, n
    out = np.empty(len(text), dtype=np.int32)
    for j, letter in enumerate(text):
        eq = at[letter]
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            edits += 1
        elif down & top:
            edits -= 1
        up, down, rows = (up << 1) & full, (down << 1) & full, eq | minus
        plus, minus = down | (full & ~(rows | up)), up & rows
        out[j] = edits
    return out


def _matched(masks: dict, n: int, window: str) -> int:
    """The most letters of the needle (``masks``: where it has each) that can be matched in order in a window."""
    row = full = (1 << n) - 1
    for letter in window:
        met = row & masks.get(letter, 0)
        row = ((row + met) | (row - met)) & full
    return n - row.bit_count()


def closest_window(needle: str, text: str, floor: float) -> tuple[float, str] | None:
    """Window of the whole text, as long as the needle give or take one, that is most similar to
    it; null below ``floor``. Of equally good windows the shorter, then the first one wins."""
    found = _closest(needle, text, floor) if len(text) >= len(needle) else None
    return None if found is None else (found[0], found[3])


def _closest(needle: str, text: str, floor: float) -> tuple[float, int, int, str] | None:
    """Ratio, size, place and text of the closest window.

    Two upper bounds of the ratio leave few windows to compare: the letters a window shares with
    the needle, and the edits needed to turn the needle into anything that ends where it ends
    (letters left unmatched on both sides are at least as many as the edits). In a short text the edits do alone.
    Windows are compared from the best bound down until no bound reaches the best ratio; a third bound, the letters
    that can be matched in order, spares most of these comparisons.
    """
    n = len(needle)
    if n == 0:
        return None
    sizes = [s for s in (n - 1, n, n + 1) if 0 < s <= len(text)]
    if len(text) > 8 * n:
        pin, hay = (np.frombuffer(s.encode("ascii"), dtype=np.uint8) for s in (needle, text))
        bounds = [2.0 * _shared_letters(pin, hay, s) / (s + n) for s in sizes]
        if all(b.max() < floor for b in bounds):
            return None
    else:
        bounds = [2.0 * min(s, n) / (s + n) for s in sizes]
    edits = _least_edits(needle, text)
    queue = []
    for size, bound in zip(sizes, bounds, strict=True):
        bound = np.minimum(bound, 1.0 - edits[size - 1:] / (size + n))
        queue += [(-bound[i], size, int(i)) for i in np.flatnonzero(bound >= floor)]
    best, place, found = floor, None, None
    matcher = SequenceMatcher(autojunk=False)
    matcher.set_seq2(needle)
    masks = {}
    for i, letter in enumerate(needle):
        masks[letter] = masks.get(letter, 0) | 1 << i
    for bound, size, i in sorted(queue):
        if -bound < best:
            break
        window = text[i:i + size]
        if 2.0 * _matched(masks, n, window) / (size + n) < best:
            continue
        matcher.set_seq1(window)
        ratio = matcher.ratio()
        if ratio > best or (ratio == best and (place is None or (size, i) < place)):
            best, place, found = ratio, (size, i), window
    return None if found is None else (best, *place, found)


def _ends(pieces: list, most: list, texts: list, of: list):
    """For each piece i: where the text ``texts[of[i]]`` has it with at most ``most[i]`` edits, as arrays (i, place of
    the last letter; a place may come twice). Myers' scan over stretches of all the texts, a letter of each at a time;
    a stretch begins as many letters early as what ends in it may have."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    letters = np.append(np.frombuffer("".join(texts).encode("ascii"), np.uint8), 0)
    length = np.array([len(x) for x in pieces], np.uint64)
    peq = np.zeros((len(pieces), 128), np.uint64)
    for i, x in enumerate(pieces):
        for k, letter in enumerate(x.encode("ascii")):
            peq[i, letter] |= np.uint64(1 << k)
    peq = peq.ravel()
    most, of = np.array(most, np.int64), np.array(of, np.int64)
    early = int((length.astype(np.int64) + most).max())
    stretches = -(-sizes[of] // _STRETCH)
    lane = np.repeat(np.arange(len(pieces)), stretches)
    start = (np.arange(len(lane)) - np.repeat(np.cumsum(stretches) - stretches, stretches)) * _STRETCH - early
    one = np.uint64(1)
    found = []
    for lo in range(0, len(lane), max(1, _TOGETHER // _STRETCH)):
        mine, at = lane[lo:lo + _TOGETHER // _STRETCH], start[lo:lo + _TOGETHER // _STRETCH]
        size, base, limit, row = sizes[of[mine]], first[of[mine]], most[mine], mine * 128
        last = length[mine] - one
        full = (one << length[mine]) - one
        plus, minus, edits = full.copy(), np.zeros(len(mine), np.uint64), length[mine].astype(np.int64)
        for step in range(early + _STRETCH):
            place = at + step
            inside = (place >= 0) & (place < size)
            # 0 is in no value: outside of its text a stretch meets nothing
            eq = peq[row + np.where(inside, letters[np.where(inside, base + place, 0)], 0)]
            across = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (full & ~(across | plus)), plus & across
            edits += (up >> last & one).astype(np.int64)
            edits -= (down >> last & one).astype(np.int64)
            up, down, rows = (up << one) & full, (down << one) & full, eq | minus
            plus, minus = down | (full & ~(rows | up)), up & rows
            hits = np.flatnonzero((edits <= limit) & inside)
            if len(hits):
                found.append((mine[hits], place[hits]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 2


def _regions(needles, texts, floor: float) -> list:
    """The regions (start, part) of each text, of those not shorter than their needle; None for the others."""
    out, pieces, most, around, of, sought = [None] * len(needles), [], [], [], [], []
    for row, (x, text) in enumerate(zip(needles, texts, strict=True)):
        if x is None or text is None or len(text) < len(x):
            continue
        n = len(x)
        errors = int((2 * n + 1) * (1.0 - floor) + 1e-9)
        if errors >= n:
            out[row] = [(0, text)]
            continue
        out[row] = []
        many = -(-n // _PIECE)
        cuts = [i * n // many for i in range(many + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            pieces.append(x[a:b])
            most.append(min(errors // many, b - a))
            # a window has the piece's end at most ``errors`` places from where the needle has it
            around.append((1 - b - errors, 2 - b + errors + n))
            of.append(len(sought))
        sought.append(row)
    if not pieces:
        return out
    which, place = _ends(pieces, most, [texts[r] for r in sought], of)
    row, (before, after) = np.array(of)[which], np.array(around)[which].T
    order = np.lexsort((place + before, row))
    last = None
    spans = {}
    for r, lo, hi in zip(row[order].tolist(), (place + before)[order].tolist(), (place + after)[order].tolist(), strict=True):
        if last is not None and r == last[0] and lo <= last[2]:
            last[2] = max(last[2], hi)
        else:
            last = [r, lo, hi]
            spans.setdefault(r, []).append(last)
    for r, found in spans.items():
        text = texts[sought[r]]
        out[sought[r]] = [(max(0, lo), text[max(0, lo):hi]) for _, lo, hi in found]
    return out


def candidate_regions(needle, text, floor: float) -> Column:
    """Parts of a text, as (``start``, ``part``), that hold every window of at least ``floor`` similarity; null for a text
    shorter than the needle.

    A window of n - 1 to n + 1 letters that reaches ``floor`` leaves at most e = (2n + 1)(1 - floor) letters of
    both sides unmatched, so at most e edits lead to it from the needle. Cut into k pieces, the needle has one with at
    most e / k of them. So only the surroundings of where a piece ends with so few edits are candidates. Needles up to
    ``_PIECE`` letters are one piece. Regions that touch are one. The texts of a batch are scanned together, a letter of
    each stretch at a time; needle and text hold capital letters and digits only."""
    @F.pandas_udf(_REGIONS)
    def regions(needle: pd.Series, text: pd.Series) -> pd.Series:
        out, rows, size = [], [], 0
        needles, texts = needle.tolist(), text.tolist()
        for lo, x in enumerate(texts):
            size += len(x) if x is not None else 0
            rows.append(lo)
            if size >= _TOGETHER or lo == len(texts) - 1:
                out += _regions(needles[rows[0]:lo + 1], texts[rows[0]:lo + 1], floor)
                rows, size = [], 0
        return pd.Series([None if r is None else [{"start": at, "part": part} for at, part in r] for r in out], dtype=object)
    return regions.asNondeterministic()(needle, text)


def window_search(floor: float):
    """UDF (needle, regions of its text, their number) -> struct(ratio, matched): the window of the whole text
    that ``closest_window`` finds; both hold capital letters and digits only. As the regions are asked for
    twice, they stay a column of their own: Spark does not take a Python function out of a projection whose
    lambdas it would hold."""
    @F.pandas_udf(_WINDOW)
    def search(needle: pd.Series, regions: pd.Series, count: pd.Series) -> pd.DataFrame:
        out = []
        for x, parts, n in zip(needle, regions, count, strict=True):
            best = None
            for r in parts if x is not None and n is not None and n > 0 else ():
                found = _closest(x, r["part"], floor)
                if found is not None:
                    rank = (-found[0], found[1], found[2] + r["start"])
                    if best is None or rank < best[0]:
                        best = rank, found[0], found[3]
            out.append(best)
        return pd.DataFrame({"ratio": [r[1] if r else None for r in out],
                             "matched": [r[2] if r else None for r in out]})
    return search.asNondeterministic()


@F.pandas_udf(StringType())
def _office_kind(content: pd.Series) -> pd.Series:
    """xlsx or docx when the zip archive holds their folder, else zip; null for null."""
    import io
    import zipfile

    def kind(data):
        if data is None:
            return None
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except zipfile.BadZipFile:
            return "zip"
        for folder, ext in (("xl/", "xlsx"), ("word/", "docx")):
            if any(n.startswith(folder) for n in names):
                return ext
        return "zip"
    return content.map(kind)


office_kind = _office_kind.asNondeterministic()
