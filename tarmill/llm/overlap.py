"""Problem 5: records of evaluation splits that occur, exactly or almost, in the training split.

Method: compressed full-text index of evaluation shards. Each shard of evaluation texts is indexed once (Burrows-Wheeler
transform with rank bit vectors, and the text and place of each suffix). Training texts stream through backward search, which
cuts each into successive matches that are extended until they are rare; spans that fall at about the same place of the same
evaluation text are merged into one candidate, which letter counts and then an exact edit distance decide.
"""

from __future__ import annotations

import io
import os
import re
import unicodedata
import uuid
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmill.functions.align import distance
from tarmill.llm import codes, forms
from tarmill.runtime import cut, fresh

LEAST_WORDS = 6
#: Share of the longer text's characters that may be added, missing or replaced, in percent.
PERCENT = 15
#: Characters of evaluation text in one index; about 40 MB of files.
SHARD_CHARS = 6_000_000
#: Texts are indexed by length, in bands of this ratio: a text is searched only where the lengths allow a match.
BAND = 1.25
#: A match is extended to the left until it occurs this often or seldomer in the shard, however long it gets. Texts that need
#: more spans use STEP times this, and so on.
RARE = 32
#: Of the spans of a text, one more than the errors allowed is kept, and a share of 1 / SPARE of those errors.
SPARE = 8
STEP = 2
JUMP = 4  # the first characters of a match are looked up in a table
ORDER = 12  # characters that the first sort of the suffixes looks at
SEGMENT = 192  # characters of a text that are searched in one row of the vectorised search
GATHERED = 50_000  # texts searched at once

_PUNCTUATION = re.compile(r"[^\w\s]|_")
_ODD = re.compile(r"[^ -~ĄČĘĖĮŠŲŪŽąčęėįšųūž\n\r\t]")
_SIGN = re.compile(r"[^a-z0-9\s]+")


def plain(text: str | None, known: forms.Lookalikes | None = None) -> str | None:
    """A text as it is compared: the consistent form, lower case, no accents and punctuation, single spaces."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKD", (known or forms.lookalikes()).consistent(text).lower())
    return " ".join(_PUNCTUATION.sub(" ", "".join(c for c in t if not unicodedata.combining(c))).split())


def comparable(text: str | None, known: forms.Lookalikes | None = None) -> str | None:
    """plain() of a text, or None if it has fewer than LEAST_WORDS words."""
    if text is None:
        return None
    if _ODD.search(text):
        t = plain(text, known)
    else:  # ASCII and letters with marks: what plain() does, faster
        t = unicodedata.normalize("NFKD", text.lower()).encode("ascii", "ignore").decode()
        if _SIGN.search(t):
            t = _SIGN.sub(" ", t)
        t = " ".join(t.split())
    return t if t.count(" ") >= LEAST_WORDS - 1 else None


# --- the index of one shard -------------------------------------------------------------------------------------------

_CODE = np.array([29 + c % 3 for c in range(0x10000)], np.uint8)
_CODE[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = np.arange(1, 27)
_CODE[ord(" ")] = 27
_CODE[[ord(c) for c in "0123456789"]] = 28


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as numbers below 32, each text followed by 0, and the start of each text. Rare letters share a number, which can
    only add candidates."""
    whole = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = _CODE[np.minimum(whole, 0xFFFF)]
    row[whole == 10] = 0
    return row, np.concatenate([[0], np.flatnonzero(row == 0) + 1])


def histogram(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How often each number occurs in each text."""
    of = np.repeat(np.arange(len(start) - 1), np.diff(start))
    return np.bincount(of * 32 + row, minlength=(len(start) - 1) * 32).reshape(-1, 32).astype(np.int32)


def _sorted(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """All suffixes in order, from their first ORDER numbers: those that are still equal are sorted by what follows, twice as far
    each time. Beyond the end of a text no order is needed."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)
    first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    rank[order] = np.repeat(first, np.diff(first, append=n))
    rank[n] = -1
    left = np.repeat(start[1:], np.diff(start)) - np.arange(n)  # numbers to the end of the text
    tied, width = order, ORDER
    while True:
        tied = tied[left[tied] > width]
        r = rank[tied]
        tied = tied[(np.diff(r, prepend=-1) == 0) | (np.diff(r, append=-1) == 0)]
        if not len(tied):
            return np.argsort(rank[:n], kind="stable")
        tied = tied[np.lexsort((rank[np.minimum(tied + width, n)], rank[tied]))]
        r, after = rank[tied], rank[np.minimum(tied + width, n)]
        new_group, new = np.diff(r, prepend=-1) != 0, np.diff(after, prepend=-2) != 0
        at = np.arange(len(tied))
        begin = np.maximum.accumulate(np.where(new_group, at, 0))
        inner = np.maximum.accumulate(np.where(new_group | new, at, 0))
        rank[tied] = r + inner - begin
        width *= 2


def build(texts: list[str]) -> dict[str, np.ndarray]:
    """The index of texts, none of which holds a line end."""
    row, start = letters(texts)
    n = len(row)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([row, np.zeros(ORDER, np.uint8)]).astype(np.uint64)
    for j in range(ORDER):
        key = (key << np.uint64(5)) | padded[j : n + j]
    order = _sorted(key, start)
    last = row[order - 1]  # the transform; order 0 wraps to the final separator
    blocks = n // 64 + 1
    bits, before = np.zeros((32, blocks), np.uint64), np.zeros((32, blocks), np.int32)
    for c in range(1, 32):
        packed = np.packbits(last == c, bitorder="little")
        bits[c] = np.concatenate([packed, np.zeros(blocks * 8 - len(packed), np.uint8)]).view(np.uint64)
        before[c, 1:] = np.cumsum(np.bitwise_count(bits[c]))[:-1]
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=32))[:-1]]).astype(np.int64)
    of = np.searchsorted(start, order, "right") - 1
    ahead = JUMP if n > 1 << 5 * JUMP else JUMP - 1
    head = (key[order] >> np.uint64(5 * (ORDER - ahead))).astype(np.int64)
    jump = np.searchsorted(head, np.arange((1 << 5 * ahead) + 1)).astype(np.int32)
    return {
        "jump": jump, "bits": bits.ravel(), "before": before.ravel(), "first": first, "of": of.astype(np.int32),
        "at": (order - start[of]).astype(np.uint16 if np.diff(start).max(initial=0) < 1 << 16 else np.int32), "start": start.astype(np.int64), "counts": histogram(row, start),
        "size": np.array([n]),
    }


def _rank(index: dict[str, np.ndarray], c: np.ndarray, i: np.ndarray, blocks: int) -> np.ndarray:
    """How often c stands before place i of the transform."""
    k = c * blocks + (i >> 6)
    below = index["bits"][k] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
    return index["before"][k] + np.bitwise_count(below)


def matches(index: dict[str, np.ndarray], row: np.ndarray, start: np.ndarray, which: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, low, high) of the successive matches of the texts numbered which, from right to left: rows low to high of
    the index hold all suffixes that begin with the match. Spans that don't occur at all have low = high."""
    n = int(index["size"][0])
    blocks = n // 64 + 1
    size = np.diff(start) - 1
    parts = np.maximum(1, -(-size[which] // SEGMENT))
    text = np.repeat(which, parts)
    k = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    left = start[text] + k * SEGMENT
    here = np.minimum(left + SEGMENT, start[text] + size[text])
    jump = index["jump"]
    ahead = (len(jump) - 1).bit_length() // 5
    low, high, end = np.zeros(len(text), np.int64), np.full(len(text), n, np.int64), here.copy()
    out = [(np.zeros(0, np.int64),) * 4]
    while len(text):
        go = here > left
        if not go.all():
            text, left, here, low, high, end = (x[go] for x in (text, left, here, low, high, end))
            if not len(text):
                break
        begin = (end == here) & (here - left >= ahead)
        a, b = np.flatnonzero(begin), np.flatnonzero(~begin)
        head = np.zeros(len(a), np.int64)
        for j in range(ahead, 0, -1):
            head = head << 5 | row[here[a] - j]
        here[a] -= ahead
        low[a], high[a] = jump[head], jump[head + 1]
        if len(b):
            here[b] -= 1
            c = row[here[b]].astype(np.int64)
            base = index["first"][c]
            low[b], high[b] = base + _rank(index, c, low[b], blocks), base + _rank(index, c, high[b], blocks)
        done = high - low <= rare
        if done.any():
            out.append((text[done], here[done] - start[text[done]], low[done], high[done]))
        low, high, end = np.where(done, 0, low), np.where(done, n, high), np.where(done, here, end)
    return tuple(np.concatenate(x) for x in zip(*out))


def allowed(longer: np.ndarray) -> np.ndarray:
    return longer * PERCENT // 100


def chosen(index: dict[str, np.ndarray], row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """matches() of all texts, and how many spans each text keeps.

    An error spoils one span at most. Texts that fall into no more spans than the errors allowed are cut again into shorter,
    more frequent ones. Then only the rarest spans of each text are kept, some more than the errors allowed: the rest isn't
    needed to find every near copy.
    """
    size = np.diff(start) - 1
    most = allowed(size * 100 // (100 - PERCENT) + 1)  # the longest text that can match
    todo, rare, got = np.flatnonzero(size > 0), RARE, []
    while len(todo):
        m = matches(index, row, start, todo, rare)
        few = np.bincount(m[0], minlength=len(size)) <= most
        again = few[todo] & (rare < int(index["size"][0]))
        got.append(tuple(x[~few[m[0]]] for x in m) if again.any() else m)
        todo, rare = todo[again], rare * STEP
    text, place, low, high = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((high - low, text))
    text, place, low, high = text[order], place[order], low[order], high[order]
    number = np.arange(len(text)) - np.searchsorted(text, text, "left")
    keep = number < (most + 1 + most // SPARE)[text]
    kept = np.bincount(text[keep], minlength=len(size))
    keep &= high > low
    return text[keep], place[keep], low[keep], high[keep], kept


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.diff(x, prepend=-1))
    return x[first], np.diff(first, append=len(x))


def candidates(index: dict[str, np.ndarray], row: np.ndarray, start: np.ndarray, block: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """(text, evaluation text) whose matches fall at places, lengths and letter counts that the allowed errors can explain.

    Of s spans at least s - errors occur in a near copy, at a distance of at most errors from their place in the text, so
    the spans of a pair are merged and counted; no pair is lost.
    """
    text, place, low, high, kept = chosen(index, row, start)
    size, other = np.diff(start) - 1, np.diff(index["start"]) - 1
    n = (high - low).astype(np.int64)
    most = allowed(size * 100 // (100 - PERCENT) + 1)[text]
    left, width = (place - most).astype(np.int32), (2 * most).astype(np.int32)
    total = np.concatenate([[0], np.cumsum(n)])
    edge = np.concatenate([np.flatnonzero(np.diff(text, prepend=-1)), [len(text)]])  # where texts begin
    found_t, found_e, x = [], [], 0
    while x < len(edge) - 1:  # occurrences, in blocks of whole texts
        y = max(x + 1, int(np.searchsorted(total[edge], total[edge[x]] + block, "right")) - 1)
        i, j = edge[x], edge[y]
        x = y
        m = n[i:j]
        suffix = np.arange(total[j] - total[i]) + np.repeat(low[i:j] - total[i:j] + total[i], m)
        off = index["at"][suffix].astype(np.int32) - np.repeat(left[i:j], m)
        near = np.flatnonzero((off >= 0) & (off <= np.repeat(width[i:j], m)))
        which = np.repeat(np.arange(i, j), m)[near]
        e = index["of"][suffix[near]]
        mine, theirs = size[text[which]], other[e]
        ok = np.abs(mine - theirs) <= np.maximum(mine, theirs) * PERCENT // 100
        once, _ = _runs(which[ok] << 32 | e[ok])  # a span counts once for a pair, however often it occurs there
        pair, k = _runs(text[once >> 32] << 32 | once & 0xFFFFFFFF)
        t, e = pair >> 32, pair & 0xFFFFFFFF
        enough = k >= kept[t] - allowed(np.maximum(size[t], other[e]))
        found_t.append(t[enough]), found_e.append(e[enough])
    if not found_t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, e = np.concatenate(found_t), np.concatenate(found_e)
    own = histogram(row, start)
    keep = []
    for a in range(0, len(t), 200_000):
        d = own[t[a : a + 200_000]] - index["counts"][e[a : a + 200_000]]
        longer = np.maximum(size[t[a : a + 200_000]], other[e[a : a + 200_000]])
        keep.append(np.maximum(np.maximum(d, 0).sum(1), np.maximum(-d, 0).sum(1)) <= allowed(longer))
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return t[keep], e[keep]


# --- files of shards in the shared folder -----------------------------------------------------------------------------


def _save(uri: str, index: dict[str, np.ndarray], keys: list[bytes], texts: list[str]) -> None:
    """Write an index under its final name in one step; a task that ran before and was lost does no harm. Any file system that
    Arrow knows will do."""
    fs, folder = FileSystem.from_uri(uri)
    if fs.get_file_info(folder).type != FileType.NotFound:
        return
    tmp = f"{folder}-{uuid.uuid4().hex}"
    fs.create_dir(tmp)
    for k, v in index.items():
        with fs.open_output_stream(f"{tmp}/{k}.npy") as f:
            held = io.BytesIO()
            np.save(held, v)
            f.write(held.getbuffer())
    with fs.open_output_stream(f"{tmp}/texts.arrow") as f:
        pa.feather.write_feather(pa.table({"key": pa.array(keys, pa.binary()), "text": pa.array(texts, pa.string())}), f, compression="uncompressed")
    try:
        fs.move(tmp, folder)
    except OSError:  # another attempt was first
        fs.delete_dir(tmp)


def _open(uri: str) -> tuple[dict[str, np.ndarray], pa.Table]:
    """An index: mapped where the folder is mounted, else read."""
    fs, folder = FileSystem.from_uri(uri)
    names = ["jump", "bits", "before", "first", "of", "at", "start", "counts", "size"]
    if isinstance(fs, LocalFileSystem):
        return {k: np.load(f"{folder}/{k}.npy", mmap_mode="r") for k in names}, pa.feather.read_table(f"{folder}/texts.arrow", memory_map=True)
    read = lambda k: fs.open_input_file(f"{folder}/{k}").read()
    return {k: np.load(io.BytesIO(read(f"{k}.npy"))) for k in names}, pa.feather.read_table(pa.BufferReader(read("texts.arrow")))


def _uri(path: str) -> str:
    """A folder as a URI; Hadoop writes local ones with one slash."""
    return path if "://" in path else "file://" + (path[len("file:"):] if path.startswith("file:") else os.path.abspath(path))


def near(train: DataFrame, held: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(train_key, held_key, edits) of all pairs within PERCENT of the longer text.

    train, held: (key binary, text), texts as plain() makes them; keys of held are different. Evaluation texts are spread over
    shards by their length, and by a hash of their key where a band of lengths holds more than shard_chars; each shard is
    indexed by one task into the shared folder, and training texts are searched, by tasks that map the files into memory, in
    the shards whose lengths they can match. Only the shards' names and lengths reach the driver.
    """
    held = held.where("text <> ''").withColumn("band", F.floor(F.log(F.length("text").cast("double")) / F.log(F.lit(BAND))).cast("int"))
    chars = held.groupBy("band").agg(F.sum(F.length("text") + 1).alias("chars"))
    held = held.join(F.broadcast(chars.select("band", F.ceil(F.col("chars") / shard_chars).cast("int").alias("cuts"))), "band")  # a row for each band
    folder = _uri(fresh(train.sparkSession, "overlap"))
    fs, path = FileSystem.from_uri(folder)
    fs.create_dir(path)

    def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, part = (int(k) for k in key)
        pdf = pdf.sort_values("key")
        _save(f"{folder}/{band}-{part}", build(pdf["text"].tolist()), [bytes(k) for k in pdf["key"]], pdf["text"].tolist())
        size = pdf["text"].str.len()
        return pd.DataFrame({"band": [band], "part": [part], "least": [int(size.min())], "most": [int(size.max())]})

    made = held.withColumn("part", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int")).groupBy("band", "part").applyInPandas(index, "band int, part int, least int, most int")
    shards = sorted((r["least"], r["most"], f"{folder}/{r['band']}-{r['part']}") for r in made.collect())  # a row for each shard

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Batches joined to some tens of thousands of rows, as each call has a fixed cost."""
        held_back: list[pa.RecordBatch] = []
        for b in batches:
            held_back.append(b)
            if sum(x.num_rows for x in held_back) >= GATHERED or sum(x.nbytes for x in held_back) >= 16_000_000:
                yield pa.Table.from_batches(held_back).combine_chunks()
                held_back = []
        if held_back:
            yield pa.Table.from_batches(held_back).combine_chunks()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            keys = b.column(0).chunk(0).cast(pa.binary()) if b.num_rows else pa.array([], pa.binary())
            texts = np.array(b.column(1).to_pylist(), object)
            size = np.array([len(t) for t in texts], np.int64)
            longest, shortest = allowed(size * 100 // (100 - PERCENT) + 1) + size, size - allowed(size)
            for least, most, name in shards:
                own = np.flatnonzero((longest >= least) & (shortest <= most))
                if not len(own):
                    continue
                idx, held_texts = _open(name)
                row, start = letters(texts[own].tolist())
                t, e = candidates(idx, row, start)
                t = own[t]
                other = held_texts.column("text").take(pa.array(e)).to_pylist()
                keep_t, keep_e, edits = [], [], []
                for i, j, o in zip(t.tolist(), e.tolist(), other):
                    limit = max(len(texts[i]), len(o)) * PERCENT // 100
                    d = distance(texts[i], o, limit)
                    if d <= limit:
                        keep_t.append(i), keep_e.append(j), edits.append(d)
                if keep_t:
                    found = held_texts.column("key").take(pa.array(keep_e, pa.int64())).combine_chunks()
                    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(keep_t, pa.int64())), found.cast(pa.binary()), pa.array(edits, pa.int32())], ["train_key", "held_key", "edits"])

    train = cut(train.where("text <> ''").groupBy("key").agg(F.first("text").alias("text")), "train")  # copies are searched once
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-train.count() // GATHERED))
    return train.repartition(parts).select("key", "text").mapInArrow(search, "train_key binary, held_key binary, edits int")


# --- records ----------------------------------------------------------------------------------------------------------


def sides(splits: DataFrame) -> DataFrame:
    """(id, train, held) for every listed id, blanks and line ends around ids and list names removed. Only train, test, dev and
    seen lists count; an id in excluded lists only has no row."""
    x = splits.select(codes.trimmed(F.col("id")).alias("id"), F.split(codes.trimmed(F.col("split_id")), r"\.")[1].alias("kind"))
    x = x.where("id <> '' and kind in ('train', 'test', 'dev', 'seen')")
    return x.groupBy("id").agg(F.max(F.col("kind") == "train").alias("train"), F.max(F.col("kind") != "train").alias("held"))


def records(clips: DataFrame, splits: DataFrame) -> DataFrame:
    """(id, train, held, key, text): clips that are in some list, with their comparable text; key and text are null for texts
    of fewer than six words. A clip that was loaded several times has as many rows; if its texts differ, each counts."""
    known = forms.lookalikes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [comparable(t, known) for t in b.column(1).to_pylist()]
            keys = [None if t is None else md5(t.encode()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["id", "key", "text"])

    c = clips.select(codes.trimmed(F.col("id")).alias("id"), "text_normalized").mapInArrow(run, "id string, key binary, text string")
    return c.join(sides(splits).hint("shuffle_hash"), "id").select("id", "train", "held", "key", "text")


def overlaps(clips: DataFrame, splits: DataFrame) -> DataFrame:
    """(id_a, id_b) of all pairs of a training clip and an evaluation clip that are the same or nearly so, smaller id first.

    Null, empty and short texts match nothing; an id in both kinds of list is paired with itself whatever its text. Each
    different evaluation text is indexed once.
    """
    r = cut(records(clips, splits), "records")
    known = r.where("key is not null")
    held = known.where("held").groupBy("key").agg(F.first("text").alias("text"))
    found = near(known.where("train").select("key", "text"), held).select("train_key", "held_key").distinct()
    a = known.where("train").select(F.col("key").alias("train_key"), F.col("id").alias("train_id")).distinct()
    b = known.where("held").select(F.col("key").alias("held_key"), F.col("id").alias("held_id")).distinct()
    found = cut(found, "found")
    pairs = found.join(a, "train_key").join(b, "held_key").select("train_id", "held_id")
    both = r.where("train and held").select(F.col("id").alias("train_id"), F.col("id").alias("held_id"))
    every = pairs.unionByName(both)
    return every.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b")).distinct()


def report(clips: DataFrame, splits: DataFrame) -> DataFrame:
    """(split_id, dataset_id, clips, overlapping): for each evaluation list and dataset, its clips and how many of them also
    occur, exactly or almost, in a training list."""
    found = overlaps(clips, splits)
    ids = found.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().withColumn("hit", F.lit(True))
    lists = splits.select(codes.trimmed(F.col("split_id")).alias("split_id"), codes.trimmed(F.col("id")).alias("id")).where(F.split("split_id", r"\.")[1].isin("test", "dev", "seen")).distinct()
    known = clips.select(codes.trimmed(F.col("id")).alias("id"), "dataset_id").distinct()
    x = lists.join(known, "id").join(ids, "id", "left")
    return x.groupBy("split_id", "dataset_id").agg(F.count(F.lit(1)).alias("clips"), F.count("hit").alias("overlapping"))
