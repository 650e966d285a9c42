"""Shingle sets as 64-bit hashes, and MinHash signatures of sets, in numpy over batches of texts."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Text bytes hashed in one go; a longer text is cut at white space (a longer word is hashed whole).
CHUNK = 1 << 20
#: Elements whose permutations are held in memory at a time.
SLICE = 1 << 17
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C55
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_powers: list[np.ndarray] = []
_table: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased UTF-8 bytes, and the byte position at which each starts.

    A word's hash sums a random number for each byte at its place, so no arrangement of bytes makes two words collide.
    """
    raw = np.frombuffer(data, np.uint8)
    edges = np.diff(np.concatenate([[True], _SPACES[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(offsets[-1] + sizes[-1]) - np.repeat(offsets, sizes)
    letters = mix(raw[~_SPACES[raw]].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)))
    return mix(np.add.reduceat(letters, offsets) + sizes.astype(np.uint64)), starts


def word_shingles(text: str) -> set[tuple[str, ...]]:
    """The shingles themselves: tuples of words; fewer words than a shingle has are one."""
    words = text.encode("utf-8").lower().split()
    return {tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))} if words else set()


def _pieces(data: bytes):
    at = 0
    while len(data) - at > CHUNK:
        cut = max(data.rfind(b" ", at, at + CHUNK), data.rfind(b"\n", at, at + CHUNK))
        if cut <= at:
            cut = min((x for x in (data.find(b" ", at + CHUNK), data.find(b"\n", at + CHUNK)) if x > 0), default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def _shingles(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and owners of words whose owners rise; owners with fewer words than a shingle get one hash."""
    n = max(0, len(words) - WORDS + 1)
    found = np.zeros(n, np.uint64)
    for k in range(WORDS):
        found += words[k : k + n] * _FACTORS[k]
    inside = owner[:n] == owner[WORDS - 1 :] if n else np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
    count = np.diff(np.concatenate([first, [len(owner)]]))
    short, lone, lone_owner = count < WORDS, [], []
    for s, c in zip(first[short], count[short]):
        lone.append(int((words[s : s + c] * _FACTORS[:c]).sum(dtype=np.uint64)) + int(c))
        lone_owner.append(owner[s])
    return mix(np.concatenate([found[inside], np.array([x % (1 << 64) for x in lone], np.uint64)])), np.concatenate([owner[:n][inside], np.array(lone_owner, owner.dtype)])


def shingle_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, as (hashes sorted within a text, offsets of the texts)."""
    datas = [b"" if t is None else t.encode("utf-8").lower() for t in texts]
    hashes, owners, batch, size = [], [], [], 0

    def flush():
        if batch:
            joined = b" ".join(d for _, d in batch)
            begin = np.cumsum([0] + [len(d) + 1 for _, d in batch[:-1]])
            words, starts = word_hashes(joined)
            owner = np.array([i for i, _ in batch])[np.searchsorted(begin, starts, "right") - 1]
            found = _shingles(words, owner)
            hashes.append(found[0])
            owners.append(found[1])
            batch.clear()

    for i, d in enumerate(datas):
        if len(d) > CHUNK:
            words = np.concatenate([word_hashes(p)[0] for p in _pieces(d)])
            found = _shingles(words, np.full(len(words), i))
            hashes.append(found[0])
            owners.append(found[1])
            continue
        if size + len(d) >= CHUNK:
            flush()
            size = 0
        batch.append((i, d))
        size += len(d) + 1
    flush()
    hashes, owners = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, int), *owners])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])]) if len(hashes) else np.zeros(0, bool)
    hashes, owners = hashes[fresh], owners[fresh]
    return hashes, np.searchsorted(owners, np.arange(len(texts) + 1))


def super_minhash(elements: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures: one row of ``slots`` values for each set; empty sets get infinities.

    Each element owns a random permutation of the slots; a slot's value is the least, over the elements, of its rank
    in the element's permutation plus a random fraction. Ranks are done one at a time for all elements of a batch, and
    a set stops as soon as no slot could still be lowered by a later rank.
    """
    sets = len(offsets) - 1
    values = np.full((sets, slots), np.inf)
    all_owners = np.repeat(np.arange(sets), np.diff(offsets))
    for at in range(0, len(elements), SLICE):
        part, owner = elements[at : at + SLICE], all_owners[at : at + SLICE]
        ranks = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(part), 1))
        for rank in range(slots):
            draw = mix(part + np.uint64((rank + 1) * _BASE % (1 << 64)))
            pick = rank + (((draw & np.uint64(0xFFFFFF)) * np.uint64(slots - rank)) >> np.uint64(24)).astype(np.int64)
            rows = np.arange(len(part))
            slot = ranks[rows, pick]
            ranks[rows, pick] = ranks[:, rank]
            np.minimum.at(values.reshape(-1), owner * slots + slot, rank + (draw >> np.uint64(24)).astype(np.float64) / 2.0**40)
            low, high = owner[0], owner[-1] + 1
            unfinished = (values[low:high].max(axis=1) >= rank + 1)[owner - low]
            if not unfinished.all():
                part, owner, ranks = part[unfinished], owner[unfinished], ranks[unfinished]
                if not len(part):
                    break
    return values


def _letters(codes: np.ndarray) -> np.ndarray:
    """A random number for each code point, from a table of those that most texts have."""
    if not len(_table):
        _table.append(mix(np.arange(1, 1 << 14, dtype=np.uint64)))
    if not len(codes) or codes.max() < len(_table[0]):
        return _table[0][codes]
    return mix(codes.astype(np.uint64) + np.uint64(1))


def character_shingles(lines: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``length`` characters and the lines they belong to; a shorter line is one shingle.

    A shingle's hash sums its letters' numbers by powers of an odd base and is mixed once, in the end.
    """
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(x) for x in lines], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    letters, base = _letters(codes), _power_tables(CHUNK + 2)[0]

    def rolled(n: int) -> np.ndarray:
        """Sums of ``n`` letters from each place on, by halves."""
        if n == 1:
            return letters
        half = rolled(n // 2)
        places = len(letters) - n + 1
        found = half[n // 2 : n // 2 + places] * base[n // 2]
        found += half[:places]
        if n % 2:
            found += letters[n - 1 :] * base[n - 1]
        return found

    whole = sizes >= length
    count = np.where(whole, sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(lines)), count)
    first = np.repeat(begins - np.cumsum(count) + count, count)
    first += np.arange(len(owner))
    found = rolled(length)[first] if len(owner) else np.zeros(0, np.uint64)
    short = np.flatnonzero(~whole)
    lone = np.array([(letters[begins[i] : begins[i] + sizes[i]] * base[: sizes[i]]).sum(dtype=np.uint64) + np.uint64(sizes[i]) for i in short], np.uint64)
    return np.concatenate([mix(found), mix(lone)]), np.concatenate([owner, short])


def character_sets(lines: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each line, as (hashes sorted within a line, offsets of the lines)."""
    hashes, owners = character_shingles(lines, length)
    ends = np.searchsorted(owners[: len(owners) - sum(len(x) < length for x in lines)], np.arange(len(lines) + 1)).tolist()
    lone = iter(hashes[ends[-1] :, None])
    sets = [np.sort(hashes[a:b]) if a < b else next(lone) for a, b in zip(ends, ends[1:])]
    hashes = np.concatenate([np.zeros(0, np.uint64), *sets])
    offsets = np.cumsum([0] + [len(s) for s in sets])
    fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
    fresh[offsets[:-1]] = True  # no set is empty
    return hashes[fresh], np.concatenate([[0], np.cumsum(fresh)])[offsets]


def line_shingles(line: str, length: int) -> set[str]:
    """The shingles themselves; a shorter line is one."""
    return {line[i : i + length] for i in range(max(1, len(line) - length + 1))}


def one_permutation_minhash(hashes: np.ndarray, owners: np.ndarray, sets: int, slots: int) -> np.ndarray:
    """MinHash signatures by one permutation: one row of ``slots`` values for each set; no set may be empty.

    The high half of a hash says the slot, the low half competes for its minimum. An empty slot borrows from the next
    filled one, with the distance mixed in, so that equal sets have equal signatures and slots agree as often as the sets.
    """
    empty = np.uint64(1 << 32)
    values = np.full(sets * slots, empty)
    slot = ((hashes >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
    np.minimum.at(values, owners * slots + slot.astype(np.int64), hashes & np.uint64(0xFFFFFFFF))
    values = values.reshape(sets, slots)
    there = np.where(values == empty, 2 * slots, np.arange(slots))
    there = np.concatenate([there, there + slots], axis=1)
    nearest = np.minimum.accumulate(there[:, ::-1], axis=1)[:, ::-1][:, :slots]
    distance = (nearest - np.arange(slots)).astype(np.uint64)
    return mix(np.take_along_axis(values, nearest % slots, axis=1) + (distance << np.uint64(32)))
