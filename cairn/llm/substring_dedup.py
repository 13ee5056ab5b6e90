"""Removal of repeated substrings over merged shard Burrows-Wheeler transforms.

A byte goes if it is covered by a ``WIDTH``-byte string that also starts in a document with a smaller id. Windows of that
width are dealt to buckets by the least hash among the ``GRAM``-byte grams they hold: equal windows share it, so every
window meets all its equals (grams are long enough that unrelated texts seldom share one). Neighbouring windows with one least hash travel as one context, the bytes they cover.

1. Each part of the documents (by hash of id and text, so that no id fills a part) tells each bucket which hashes it holds, once each.
2. A bucket answers each part which of them lie in two documents or more.
3. The part sends the contexts of those to the buckets, equal ones once, with their smallest and largest id.
4. The bucket folds equal contexts (a context that two parts sent is one string) and deals them to shards by the part that
   sent them first. Each shard gets its Burrows-Wheeler transform, the transforms are merged by interleave refinement, and
   each repeated interval of common prefix WIDTH takes its smallest id: every window's answer is read off the merged order.
   The answer goes back to the parts as runs of windows.
5. The part marks the covered bytes of its documents.

Scale: parts hold about ``PART_BYTES`` of text and buckets follow their number; a passage with many copies reaches a bucket
once per part and is folded there. Transforms are made of shared contexts only: of all bytes they would need the interleave of
the whole corpus, 50 rounds over every suffix, in each of them (8 rounds of 7 symbols, 16 bytes a suffix: over 100 times the input shuffled). All steps are one plan, in which the exchange of the texts is reused.

Edge cases: null text is empty; texts shorter than WIDTH are kept; rows of one id do not remove each other's bytes; null
ids count as one id, the largest; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import least_by_window
from .common import mix64, slices, text_or_empty

WIDTH, GRAM = 50, 24
PART_BYTES = 8 << 20
SLICE_BYTES = 1 << 19
MERGE_BYTES = 1 << 17
SHARDS = 8
NO_ID = np.iinfo(np.int64).max


def least_hashes(buf: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For every window of ``width`` bytes: the remixed least hash of the grams it holds."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.lib.stride_tricks.as_strided(buf[: len(buf) // 8 * 8].view("<u8"), (len(buf) - 7,), (1,))
    h = mix64(words[:-16] * np.uint64(0xC2B2AE3D27D4EB4F) + words[8:-8] * np.uint64(0x165667B19E3779F9) + words[16:] * np.uint64(0x27D4EB2F165667C5))
    reach, span = 1, width - GRAM + 1
    while 2 * reach <= span:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    return mix64(np.minimum(h[:n], h[span - reach : span - reach + n]))


def contexts(texts: list[bytes], width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with one least hash, slice by slice: (text number, first window, windows, hash)."""
    for a, b in slices(np.array([len(t) for t in texts]), SLICE_BYTES):
        joined = b"".join(texts[a:b])
        buf = np.frombuffer(joined + b"\0" * 8, np.uint8)[: len(joined)]
        h = least_hashes(buf, width)
        if not len(h):
            continue
        sizes = np.array([len(t) for t in texts[a:b]])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = owner[: len(h)] == owner[width - 1 :]
        cut = np.r_[True, (h[1:] != h[:-1]) | (owner[1 : len(h)] != owner[: len(h) - 1]) | (inside[1:] != inside[:-1])]
        first = np.flatnonzero(cut)
        count = np.diff(np.r_[first, len(h)])
        keep = inside[first]
        first, count = first[keep], count[keep]
        whose = owner[first]
        yield a + whose, first - (ends - sizes)[whose], count, h[first]


def ordered(pdf: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a part in one order, whatever the order of arrival."""
    rows = sorted(zip((NO_ID if pd.isna(i) else int(i) for i in pdf.id), map(bytes, pdf.text), strict=True))
    return np.array([i for i, _ in rows], np.int64), [t for _, t in rows]


def bucket_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a hash and the 32 bits that tell hashes apart in it (a clash only costs a comparison)."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    return bucket, ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    values, at = np.unique(bucket[order], return_index=True)
    for v, rows in zip(values, np.split(order, at[1:]), strict=True):
        yield int(v), rows


def told_hashes(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Step 1."""
    ids, texts = ordered(pdf)
    part, out = int(pdf.part.iloc[0]), []
    found = [(ids[whose], h) for whose, _, _, h in contexts(texts)]
    if found:
        who, h = np.concatenate([w for w, _ in found]), np.concatenate([x for _, x in found])
        order = np.argsort(h, kind="stable")
        who, h = who[order], h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        many = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        bucket, low = bucket_of(h[first], bits)
        out = [(b, part, low[rows].tobytes(), many[rows].tobytes()) for b, rows in by_bucket(bucket)]
    return pd.DataFrame(out, columns=["bucket", "part", "low", "many"])


def shared_hashes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2."""
    low = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf.low])
    many = np.concatenate([np.frombuffer(x, bool) for x in pdf.many])
    values, back, parts = np.unique(low, return_inverse=True, return_counts=True)
    hit = parts > 1
    np.logical_or.at(hit, back, many)
    out, at = [], 0
    for part, blob in zip(pdf.part, pdf.low, strict=True):
        n = len(blob) // 4
        own = np.sort(low[at : at + n][hit[back[at : at + n]]])
        at += n
        if len(own):
            out.append((int(part), int(pdf.bucket.iloc[0]), own.tobytes()))
    return pd.DataFrame(out, columns=["part", "bucket", "low"])


def shared_contexts(docs: pd.DataFrame, shared: pd.DataFrame, bits: int):
    """The contexts of a part under shared hashes: ids, texts, and (text number, first window, number of the context) of
    each, and the distinct contexts as {(hash, bytes): number} in order of appearance with least and largest id."""
    ids, texts = ordered(docs)
    answers = {int(b): np.frombuffer(x, np.uint32) for b, x in zip(shared.bucket, shared.low, strict=True)}
    known: dict[tuple[int, bytes], int] = {}
    low_id, high_id, places = [], [], []
    for whose, first, count, h in contexts(texts):
        bucket, low = bucket_of(h, bits)
        hit = np.zeros(len(h), bool)
        for b, rows in by_bucket(bucket):
            own = answers.get(b)
            if own is not None:
                hit[rows] = own[np.minimum(np.searchsorted(own, low[rows]), len(own) - 1)] == low[rows]
        for w, f, c, x in zip(whose[hit].tolist(), first[hit].tolist(), count[hit].tolist(), h[hit].tolist(), strict=True):
            key = (x, texts[w][f : f + c + WIDTH - 1])
            number = known.setdefault(key, len(known))
            who = int(ids[w])
            if number == len(low_id):
                low_id.append(who)
                high_id.append(who)
            else:
                high_id[number] = who  # texts come by rising id
            places.append((w, f, number))
    return ids, texts, places, known, low_id, high_id


def sent_contexts(docs: pd.DataFrame, shared: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Step 3."""
    out = []
    if len(docs) and len(shared):
        _, _, _, known, low_id, high_id = shared_contexts(docs, shared, bits)
        keys = list(known)
        h = np.array([k for k, _ in keys], np.uint64)
        lows, highs, part = np.array(low_id, np.int64), np.array(high_id, np.int64), int(docs.part.iloc[0])
        for b, rows in by_bucket(bucket_of(h, bits)[0]) if len(h) else ():
            data = [keys[r][1] for r in rows]
            sizes = np.array([len(d) for d in data], np.uint32)
            out.append((b, part, h[rows].tobytes(), sizes.tobytes(), b"".join(data), lows[rows].tobytes(), highs[rows].tobytes(), rows.astype(np.uint32).tobytes()))
    return pd.DataFrame(out, columns=["bucket", "part", "hashes", "sizes", "data", "lows", "highs", "numbers"])


def merged_windows(strings: list[bytes], least: np.ndarray, shard: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (first window, end, least id) of each string's windows, over the merged transforms of the shards."""
    members = [np.flatnonzero(shard == s) for s in np.unique(shard)]
    found = least_by_window([[strings[i] for i in own] for own in members], [least[own] for own in members], WIDTH)
    ids: list[np.ndarray] = [None] * len(strings)  # type: ignore[list-item]
    for own, windows in zip(members, found, strict=True):
        for i, x in zip(own, windows, strict=True):
            ids[i] = x
    flat = np.concatenate(ids)
    starts = np.cumsum([len(x) for x in ids]) - [len(x) for x in ids]
    new = np.r_[True, flat[1:] != flat[:-1]]
    new[starts] = True
    cut = np.flatnonzero(new)
    owner = np.searchsorted(starts, cut, "right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in strings]
    for w, a, b, low in zip(owner.tolist(), (cut - starts[owner]).tolist(), (np.r_[cut[1:], len(flat)] - starts[owner]).tolist(), flat[cut].tolist(), strict=True):
        out[w].append((a, b, low))
    return out


def answered_contexts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 4."""
    entries: dict[tuple[int, bytes], int] = {}
    least: list[int] = []
    shards: list[int] = []
    asked: list[list[int]] = []  # per row: the distinct context of each of its contexts
    pdf = pdf.sort_values("part")
    for part, hashes, sizes, data, lows in zip(pdf.part, pdf.hashes, pdf.sizes, pdf.data, pdf.lows, strict=True):
        own, at = [], 0
        for h, size, low in zip(np.frombuffer(hashes, np.uint64).tolist(), np.frombuffer(sizes, np.uint32).tolist(), np.frombuffer(lows, np.int64).tolist(), strict=True):
            number = entries.setdefault((h, data[at : at + size]), len(entries))
            at += size
            if number == len(least):
                least.append(low)
                shards.append(int(part) % SHARDS)
            elif low < least[number]:
                least[number] = low
            own.append(number)
        asked.append(own)
    order = sorted(range(len(least)), key=[h for h, _ in entries].__getitem__)
    keys, low_ids, shard = list(entries), np.array(least, np.int64), np.array(shards, np.int64)
    windows: dict[int, list[tuple[int, int, int]]] = {}
    batch: list[int] = []
    size = 0

    def merge() -> None:
        if batch:
            windows.update(zip(batch, merged_windows([keys[i][1] for i in batch], low_ids[batch], shard[batch]), strict=True))
            batch.clear()

    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and keys[order[end]][0] == keys[order[at]][0]:
            end += 1
        group = order[at:end]  # contexts of one hash stay together: only they can hold equal windows
        weight = sum(len(keys[i][1]) for i in group)
        if size + weight > MERGE_BYTES:
            merge()
            size = 0
        batch.extend(group)
        size += weight
        at = end
    merge()

    out = []
    for part, own, highs, numbers in zip(pdf.part, asked, pdf.highs, pdf.numbers, strict=True):
        spans = []
        for number, context, high in zip(np.frombuffer(numbers, np.uint32).tolist(), own, np.frombuffer(highs, np.int64).tolist(), strict=True):
            spans += [(number, a, b, low) for a, b, low in windows[context] if low < high]
        if spans:
            out.append((int(part), np.array(spans, np.int64).tobytes()))
    return pd.DataFrame(out, columns=["part", "spans"])


def cleaned(docs: pd.DataFrame, shared: pd.DataFrame, answers: pd.DataFrame, bits: int) -> Iterator[tuple]:
    """Step 5: (id, bytes, removed, runs removed, text that stays) of each document of a part."""
    if len(shared) and len(answers):
        ids, texts, places, *_ = shared_contexts(docs, shared, bits)
    else:
        (ids, texts), places = ordered(docs), []
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for blob in answers.spans if len(answers) else ():
        for number, a, b, low in np.frombuffer(blob, np.int64).reshape(-1, 4).tolist():
            spans.setdefault(number, []).append((a, b, low))
    marks: dict[int, list[tuple[int, int]]] = {}
    for w, first, number in places:
        for a, b, low in spans.get(number, ()):
            if low < ids[w]:
                marks.setdefault(w, []).append((first + a, first + b + WIDTH - 1))
    for w, (who, text) in enumerate(zip(ids.tolist(), texts, strict=True)):
        kept, at, runs, removed = [], 0, 0, 0
        open_, close = -1, -1
        for a, b in sorted(marks.get(w, ())):
            if a <= close:
                close = max(close, b)
                continue
            if open_ >= 0:
                kept.append(text[at:open_])
                at, runs, removed = close, runs + 1, removed + close - open_
            open_, close = a, b
        if open_ >= 0:
            kept.append(text[at:open_])
            at, runs, removed = close, runs + 1, removed + close - open_
        kept.append(text[at:])
        yield (None if who == NO_ID else who), len(text), removed, runs, b"".join(kept)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the bytes that stay; with ``digest`` their sha256 in hex as text)."""
    text = text_or_empty(text_col).cast("binary")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_or_empty(text_col))), F.lit(0)).alias("n")).first().n
    bits = max(0, int(-(-total // PART_BYTES)) - 1).bit_length()
    rows = docs.select(F.pmod(F.xxhash64(id_col, text), F.lit(1 << bits)).cast("int").alias("part"), F.col(id_col).cast("string").alias("id"), text.alias("text"))
    told = rows.groupBy("part").applyInPandas(lambda p: told_hashes(p, bits), "bucket long, part int, low binary, many binary")
    shared = told.groupBy("bucket").applyInPandas(shared_hashes, "part int, bucket long, low binary")
    sent = rows.groupBy("part").cogroup(shared.groupBy("part")).applyInPandas(
        lambda d, s: sent_contexts(d, s, bits), "bucket long, part int, hashes binary, sizes binary, data binary, lows binary, highs binary, numbers binary"
    )
    answers = sent.groupBy("bucket").applyInPandas(answered_contexts, "part int, spans binary")
    # a cogroup has two sides: both answers for a part go as one table
    both = shared.select("part", "bucket", "low", F.lit(None).cast("binary").alias("spans")).unionByName(
        answers.select("part", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("low"), "spans")
    )

    def finish(d: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = list(cleaned(d, told[told.low.notna()], told[told.spans.notna()], bits)) if len(d) else []
        if digest:
            out = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in out]
        frame = pd.DataFrame([r[1:] for r in out], columns=["n_bytes", "n_removed", "n_spans", "kept"])
        frame.insert(0, "id", pd.array([r[0] for r in out], "Int64"))
        return frame

    kept = "string" if digest else "binary"
    return rows.groupBy("part").cogroup(both.groupBy("part")).applyInPandas(finish, f"id long, n_bytes long, n_removed long, n_spans long, kept {kept}")
