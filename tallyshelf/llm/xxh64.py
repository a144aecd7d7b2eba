"""XXH64 of many slices of one byte array at once (the published algorithm, in numpy)."""

import numpy as np

#: Fixed values of the algorithm.
P1, P2, P3, P4, P5 = (
    np.uint64(p)
    for p in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(state + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of data[starts[i]:ends[i]]; ``data`` is uint8."""
    raw = np.append(data, np.zeros(8, np.uint8)).tobytes()
    eights = np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))
    fours = np.ndarray(len(data) + 1, "<u4", raw, strides=(1,))
    start = np.uint64(seed)
    length = ends - starts
    at, left = starts.copy(), length.copy()
    out = np.full(len(starts), start + P5)
    with np.errstate(over="ignore"):
        wide = np.flatnonzero(length >= 32)
        if len(wide):
            state = [np.full(len(wide), x) for x in (start + P1 + P2, start + P2, start, start - P1)]
            going = np.arange(len(wide))
            while len(going):
                where = at[wide[going]]
                for k in range(4):
                    state[k][going] = _round(state[k][going], eights[where + 8 * k])
                at[wide[going]] += 32
                left[wide[going]] -= 32
                going = going[left[wide[going]] >= 32]
            merged = sum(_turn(s, r) for s, r in zip(state, (1, 7, 12, 18)))
            for s in state:
                merged = (merged ^ _round(np.zeros_like(s), s)) * P1 + P4
            out[wide] = merged
        out += length.astype(np.uint64)
        while len(some := np.flatnonzero(left >= 8)):
            lane = _round(np.uint64(0), eights[at[some]])
            out[some] = _turn(out[some] ^ lane, 27) * P1 + P4
            at[some] += 8
            left[some] -= 8
        some = np.flatnonzero(left >= 4)
        out[some] = _turn(out[some] ^ (fours[at[some]].astype(np.uint64) * P1), 23) * P2 + P3
        at[some] += 4
        left[some] -= 4
        while len(some := np.flatnonzero(left > 0)):
            out[some] = _turn(out[some] ^ (data[at[some]].astype(np.uint64) * P5), 11) * P1
            at[some] += 1
            left[some] -= 1
        out ^= out >> np.uint64(33)
        out *= P2
        out ^= out >> np.uint64(29)
        out *= P3
        out ^= out >> np.uint64(32)
    return out
