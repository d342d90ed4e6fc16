"""The best items of each query by word overlap and contained phrases, exactly, for items that fit into memory."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores are rounded to six digits later; what is nearer than this to the kth score stays.
NEAR = 2e-6


def _places(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that groups rows by their value below ``n``, rows of one value as they come, and where each value begins."""
    return np.argsort(values, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(values, minlength=n))])


def _rank_in_run(*keys: np.ndarray) -> np.ndarray:
    """How many rows before a row belong to its run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(at, np.diff(np.append(at, len(new))))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and token of every word, by text, and the squared norm of each text's bag. The second occurrence of a word in a text is a token of its own, so bags overlap by as many words as they share tokens."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, "[^a-z0-9]+", " "), " ")
    owner, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    some = pc.not_equal(words, "")
    coded = words.filter(some).dictionary_encode()
    n_words = max(1, len(coded.dictionary))
    key = np.sort(owner.filter(some).to_numpy() * np.int64(n_words) + coded.indices.to_numpy())
    nth = _rank_in_run(key)
    owner, token = np.divmod(key, n_words)
    again = nth > 0
    if again.any():
        token[again] = n_words + np.unique(nth[again] * np.int64(n_words) + token[again], return_inverse=True)[1]
    return owner, token, np.bincount(owner, weights=2 * nth + 1, minlength=len(texts))  # the sum of odd numbers is a square


def _contained(parts: list[bytes], texts: list[bytes]) -> list[list[int]]:
    """For each text the numbers of the parts that it contains as they stand. Parts are found by their first four bytes, looked up for all places at once, and then by the lengths that occur behind these. UTF-8 has no byte 255."""
    number, lengths, found = {p: i for i, p in enumerate(parts)}, defaultdict(set), [set() for _ in texts]
    for p in parts:
        lengths[p[:4]].add(len(p))
    whole = b"\xff".join(texts) + b"\xff" * 4
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    place = np.frombuffer(whole, "u1").astype("u4")
    for n in sorted({len(p) for p in lengths}):
        cell = lambda x, n=n: sum(x[i : len(x) - n + 1 + i] << np.uint32(8 * i) for i in range(n)).astype("u4") * np.uint32(2654435761) >> np.uint32(10)
        there = np.zeros(1 << 22, bool)
        there[[int(cell(np.frombuffer(p, "u1").astype("u4"))[0]) for p in lengths if len(p) == n]] = True
        hits = np.flatnonzero(there[cell(place)])
        for at, j in zip(hits.tolist(), (np.searchsorted(begins, hits, "right") - 1).tolist(), strict=True):
            for length in lengths.get(whole[at : at + n], ()) if n == 4 else (n,):
                if (i := number.get(whole[at : at + length])) is not None:
                    found[j].add(i)
    return [sorted(x) for x in found]


def best(queries: pa.Array, ids: pa.Array, texts: pa.Array, phrases: pa.Array, k: int, common: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, item and unrounded score of the k best items of each query, and of what rounding could tie with the kth.

    ``queries`` and ``texts`` are lower case. Items are numbered by norm and id. Of items with equal overlap, norm and phrases only
    the first k can be among the best. An item that a query meets through no phrase and no rare word has the overlap that the
    query's common words (in more than the share ``common`` of the items) give; the first k of each overlap and norm are found
    once for all queries with the same common words. All others are in the lists of the rare words and phrases.
    """
    n, none = len(texts), (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
    if not n or not len(queries):
        return none
    owner, token, squares = _tokens(pa.concat_arrays([texts, queries]))
    order = pc.sort_indices(pa.table({"n": squares[:n], "id": ids}), [("n", "ascending"), ("id", "ascending")]).to_numpy().astype("i8")
    place = np.empty(n, "i8")
    place[order] = np.arange(n)
    norm, q_norm, n_tokens = np.sqrt(squares[:n])[order], np.sqrt(squares[n:]), int(token.max(initial=-1)) + 1
    segment = np.cumsum(np.append(0, norm[1:] != norm[:-1]))
    norm = np.maximum(norm, 1)  # of texts without a word, which nothing meets
    cut = np.searchsorted(owner, n)
    at, of = place[owner[:cut]], token[:cut]
    by, begin = _places(at, n)
    at, of = at[by], of[by]
    by, begin = _places(of, n_tokens)
    post, begin, df = at[by], begin.tolist(), np.diff(begin).tolist()

    flat, item = pc.list_flatten(phrases), place[pc.list_parent_indices(phrases).to_numpy()]
    given = pc.fill_null(pc.not_equal(flat, ""), False)
    coded, item = flat.filter(given).dictionary_encode(), item[given.to_numpy(zero_copy_only=False)]
    pairs, times = np.unique(coded.indices.to_numpy().astype("i8") * n + item, return_counts=True)
    part, p_item = np.divmod(pairs, n)
    p_begin = np.searchsorted(part, np.arange(len(coded.dictionary) + 1)).tolist()
    inside = _contained(coded.dictionary.cast("binary").to_pylist(), queries.cast("binary").to_pylist())

    starts, asked, often = np.searchsorted(owner[cut:], np.arange(n, n + len(queries) + 1)).tolist(), token[cut:].tolist(), common * n
    groups = defaultdict(list)
    for j in range(len(queries)):
        known = [t for t in asked[starts[j] : starts[j + 1]] if df[t]]
        groups[tuple(t for t in known if df[t] > often)].append((j, [t for t in known if df[t] <= often]))
    dense, overlap, bonus, out = {}, np.zeros(n, "i4"), np.zeros(n, "i4"), []
    for frequent, members in groups.items():
        base = np.zeros(n, "i4")
        for t in frequent:
            if df[t] < n // 20:
                base[post[begin[t] : begin[t + 1]]] += 1
                continue
            if t not in dense:
                dense[t] = np.zeros(n, "u1")
                dense[t][post[begin[t] : begin[t + 1]]] = 1
            base += dense[t]
        worth = base / norm
        first = np.flatnonzero(base)
        if len(first) > k:
            near = NEAR * max(q_norm[j] for j, _ in members)
            first = np.flatnonzero(worth >= max(1e-9, np.partition(worth, n - k)[n - k] - near))
        key = segment[first] * (len(frequent) + 1) + base[first]
        o = np.argsort(key, kind="stable")
        first = first[o][_rank_in_run(key[o]) < k]
        worth = worth[first]
        o = np.argsort(-worth, kind="stable")
        first, worth = first[o], worth[o]
        for j, rare in members:
            lists = [post[begin[t] : begin[t + 1]] for t in rare]
            for x in lists:
                overlap[x] += 1
            for p in inside[j]:
                x = p_item[p_begin[p] : p_begin[p + 1]]
                bonus[x] += times[p_begin[p] : p_begin[p + 1]]
                lists.append(x)
            lists.append(first[: np.searchsorted(-worth, NEAR * q_norm[j] - worth[k - 1], "right")] if len(first) > k else first)
            c = np.concatenate(lists)
            shared = overlap.take(c) + base.take(c)
            if inside[j]:  # a phrase alone is not enough
                c, shared = c[shared > 0], shared[shared > 0]
            score = shared / (q_norm[j] * norm.take(c))
            if inside[j]:
                score += 0.25 * bonus.take(c)
            for x in lists[:-1]:
                overlap[x] = 0
                if inside[j]:
                    bonus[x] = 0
            if len(c) > (some := k * len(lists)):  # an item is in each list once at most
                keep = score >= np.partition(score, len(c) - some)[len(c) - some] - NEAR
                c, score = c[keep], score[keep]
            c, i = np.unique(c, return_index=True)
            score = score[i]
            if len(c) > k:
                kth = np.partition(score, len(c) - k)[len(c) - k]
                sure, near = score > kth + NEAR, np.flatnonzero(np.abs(score - kth) <= NEAR)
                near = near[np.argsort(score[near], kind="stable")]
                near = near[_rank_in_run(score[near], segment[c[near]]) < k - sure.sum()]
                keep = np.concatenate([np.flatnonzero(sure), near])
                c, score = c[keep], score[keep]
            out.append((np.full(len(c), j), order[c], score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none
