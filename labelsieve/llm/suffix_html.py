"""Main text of web pages: markup first, then what pages of one host repeat.

Pages are cut into blocks of text, each inside or outside an article element, or in a part that is no main text by its
element or class (navigation, footer, advert, form, comments ...). The token streams of a host's pages are concatenated
and a suffix array over them shows the long runs that occur on distinct pages. Pages of a large host are dealt over
parts with a suffix array each; the suffixes of all parts that begin with the same run meet in one group, so a run on two
pages is found wherever they lie. An article is the main text where a page has one, also if other pages quote it. Without
one, the main text is what remains outside such parts once the repeated runs are removed.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.session import materialize

RUN_WORDS = 8
PART_BYTES = 8 << 20
GROUP_PARTS = 4  # runs of a large host are dealt over a group for every so many parts
PACK_RUNS = 1 << 20
PACKS = "_host string, _group int, hashes binary, sizes binary, pages binary, parts binary"
PACK_NAMES = [column.split()[0] for column in PACKS.split(", ")]
_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
ARTICLE, OTHER, REMOVED = 0, 1, 2

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video".split())
_NO_MAIN = _RAW | frozenset("head nav header footer aside form select button dialog menu".split())
_BLOCKS = frozenset(
    "p div section article main body html h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote "
    "pre figure figcaption hr address fieldset legend details summary nav header footer aside form menu dialog option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FRAMES = frozenset("html body main article".split())
_CLOSED_BY_BLOCK = frozenset(["p"])
_NAMES = frozenset(
    "ad ads advert advertisement adverts banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer cookie cookies "
    "notice alert popup modal newsletter subscribe share sharing social promo sponsored related comment comments complementary "
    "contentinfo search pagination skip".split())


def names_no_main(attributes: str) -> bool:
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for name in (a or b or c).lower().split():
            if name in _NAMES or re.split("[-_]", name)[0] in _NAMES and name.count("-") + name.count("_") > 0:
                return True
    return False


def is_main(name: str, attributes: str) -> bool:
    return name in ("article", "main") or any(key == "role" and "main" in (a or b or c).lower().split() for key, a, b, c in _ATTRIBUTE.findall(attributes.lower()))


def text_of_block(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def blocks_of(page: str) -> tuple[list[str], list[int]]:
    """The blocks of a page in order, and of each whether it is in an article, elsewhere, or in no main text."""
    texts: list[str] = []
    kinds: list[int] = []
    parts: list[str] = []
    articles: list[str] = []
    out_name, out_depth, out_articles, at = "", 0, 0, 0

    def finish() -> None:
        if parts:
            text = text_of_block(parts)
            parts.clear()
            if text:
                texts.append(text)
                kinds.append(REMOVED if out_depth else ARTICLE if articles else OTHER)

    while True:
        match = _TAG.search(page, at)
        parts.append(page[at:match.start() if match else len(page)])
        if match is None:
            break
        at = match.end()
        name = (match.group(2) or "").lower()
        if not name:
            continue
        closing, attributes = match.group(1) == "/", match.group(3)
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCKS or name in _NO_MAIN:
            finish()
        if out_depth and not closing and out_name in _CLOSED_BY_BLOCK and name in _BLOCKS:
            out_depth = 0
        if closing:
            if out_depth and name == out_name:
                out_depth -= 1
            elif name in ("article", "main") or articles and articles[-1] == name:
                if articles and name in articles:
                    while articles.pop() != name:
                        pass
                    if out_depth and len(articles) < out_articles:
                        out_depth = 0
            elif name in ("body", "html"):
                out_depth = 0
            continue
        if name in _VOID or attributes.endswith("/") and name not in _BLOCKS:
            continue
        if name in _RAW and name not in ("svg", "math", "object"):
            end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if out_depth:
            out_depth += name == out_name
        elif name not in _FRAMES and (name in _NO_MAIN or attributes and names_no_main(attributes)):
            out_name, out_depth, out_articles = name, 1, len(articles)
        elif is_main(name, attributes):
            articles.append(name)
    finish()
    return texts, kinds


def pack_blocks(blocks: list[str]) -> bytes:
    """Blocks hold no line feed and are not empty."""
    return zlib.compress("\n".join(blocks).encode(), 1)


def unpack_blocks(page: bytes) -> list[str]:
    text = zlib.decompress(page).decode()
    return text.split("\n") if text else []


def repeated_words(tokens: np.ndarray, pages: np.ndarray, run: int) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that also occurs on another page.

    Suffixes are ranked by their first 1, 2, 4 ... tokens; in the suffix array, neighbours of equal rank share a run.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(n, dtype=bool)
    _, rank = np.unique(tokens, return_inverse=True)
    width = 1
    while width < run:
        step = min(width, run - width)
        rest = np.full(n, n, dtype=np.int64)
        rest[:n - step] = rank[step:]
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + rest, return_inverse=True)
        width += step
    whole = np.flatnonzero(pages[run - 1:] == pages[:n - run + 1])  # runs that stay on their page
    order = whole[np.argsort(rank[whole], kind="stable")]
    covered = np.zeros(n + 1, dtype=np.int64)
    if len(order):
        begins = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
        lowest, highest = np.minimum.reduceat(pages[order], begins), np.maximum.reduceat(pages[order], begins)
        shared = order[np.repeat(lowest < highest, np.diff(np.append(begins, len(order))))]
        np.add.at(covered, shared, 1)
        np.add.at(covered, shared + run, -1)
    return np.cumsum(covered[:n]) > 0


def run_hashes(words: list[str], codes: np.ndarray, run: int) -> np.ndarray:
    """64-bit hash of the ``run`` tokens from each position; ``codes`` are positions in ``words``."""
    n = max(len(codes) - run + 1, 0)
    token = pd.util.hash_array(np.array(words, dtype=object), categorize=False)[codes] if n else np.zeros(0, dtype=np.uint64)
    hashed = np.zeros(n, dtype=np.uint64)
    for k in range(run if n else 0):
        hashed = (hashed ^ token[k:k + n]) * _GOLDEN
        hashed = (hashed ^ (hashed >> np.uint64(29))) * _MIX
    return hashed ^ (hashed >> np.uint64(32))


def page_key(blocks: list[str]) -> int:
    """Of the words of a page: copies under other addresses or markup share it."""
    return int.from_bytes(hashlib.blake2b(" ".join(blocks).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def run_sketches(words: list[str], codes: np.ndarray, run: int) -> np.ndarray:
    """32 bits of the ``run`` tokens from each position that about three neighbouring runs share: their least half run."""
    half = (run + 1) // 2
    hashed = run_hashes(words, codes, half)
    n = max(len(codes) - run + 1, 0)
    least = np.full(n, np.iinfo(np.uint64).max)
    for k in range(run - half + 1 if n else 0):
        least = np.minimum(least, hashed[k:k + n])
    return ((least * _GOLDEN) >> np.uint64(32)).astype(np.uint32)


def words_of(blocks: list[str]) -> tuple[list[str], np.ndarray]:
    codes, words = pd.factorize(np.array([w for block in blocks for w in block.split(" ")], dtype=object))
    return list(words), codes


def packs_of(host: str, groups: int, pages: list[tuple[int, int, np.ndarray]]) -> list[tuple]:
    """Rows of ``PACKS`` from (key, part, hashes) of pages of a host; of a part's equal hashes, the lowest and highest key."""
    pages = sorted(pages, key=lambda p: p[0])
    hashes = np.concatenate([p[2] for p in pages])
    page = np.repeat(np.arange(len(pages)), [len(p[2]) for p in pages])
    keys, parts = (np.array([p[i] for p in pages], dtype=t) for i, t in ((0, np.int64), (1, np.int32)))
    order = np.lexsort((page, parts[page], hashes))
    hashes, page = hashes[order], page[order]
    new = np.append((hashes[1:] != hashes[:-1]) | (parts[page[1:]] != parts[page[:-1]]), True)
    ends = np.roll(new, 1) | new if len(hashes) else np.zeros(0, dtype=bool)
    hashes, page = hashes[ends], page[ends]
    group = (hashes % groups).astype(np.int64)
    order = np.lexsort((page, group))
    hashes, page, group = hashes[order], page[order], group[order]
    rows, start = [], 0
    for end in np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1 if len(hashes) else []:
        mine, sizes = np.unique(page[start:end], return_counts=True)
        rows.append((host, int(group[start]), hashes[start:end].tobytes(), sizes.astype(np.int32).tobytes(),
                     keys[mine].tobytes(), parts[mine].tobytes()))
        start = end
    return rows


def on_several_pages(packs: DataFrame, kind: type) -> DataFrame:
    """(_host, _part, hashes): of each part's hashes those that pages with other words have in other parts of the host.

    Runs that several pages of the part have are left out, its suffix array finds them.
    """
    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        hashes, sizes, pages, parts = (
            np.concatenate([np.frombuffer(b, dtype=t) for b in frame[c]])
            for c, t in (("hashes", kind), ("sizes", np.int32), ("pages", np.int64), ("parts", np.int32)))
        order = np.argsort(hashes, kind="stable")
        hashes, pages, parts = hashes[order], np.repeat(pages, sizes)[order], np.repeat(parts, sizes)[order]
        begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        several = np.logical_and(*(np.minimum.reduceat(c, begins) < np.maximum.reduceat(c, begins) for c in (pages, parts)))
        shared = np.repeat(several, np.diff(np.append(begins, len(hashes))))
        hashes, parts = hashes[shared], parts[shared]
        order = np.lexsort((hashes, parts))
        hashes, parts = hashes[order], parts[order]
        begins = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (parts[1:] != parts[:-1]))[:len(hashes)])
        if kind is np.uint64:
            begins = begins[np.diff(np.append(begins, len(hashes))) == 1]
        hashes, parts = hashes[begins], parts[begins]
        each, begins = np.unique(parts, return_index=True)
        return pd.DataFrame({"_host": frame["_host"].iloc[0], "_part": each.astype(np.int64),
                             "hashes": [mine.tobytes() for mine in np.split(hashes, begins[1:])] if len(each) else []})

    return packs.groupBy("_host", "_group").applyInPandas(meet, "_host string, _part long, hashes binary")


def shared_sketches(large: DataFrame, html: str, run: int) -> DataFrame:
    """``on_several_pages`` of the sketches of pages with the columns _host, _part, _parts and ``html``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[int, int, np.ndarray]]] = {}
        seen: set[tuple[str, int, int]] = set()
        total = 0

        def flush() -> pa.RecordBatch:
            rows = [row for (host, groups), pages in held.items() for row in packs_of(host, groups, pages)]
            types = pa.string(), pa.int32(), *[pa.binary()] * 4
            columns = zip(*rows) if rows else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=PACK_NAMES)

        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                some = batch.slice(first, 1000)
                for host, part, parts, page in zip(*(some.column(i).to_pylist() for i in range(4))):
                    blocks = blocks_of(page or "")[0]
                    key = page_key(blocks)
                    if (host, part, key) in seen:
                        continue
                    seen.add((host, part, key))
                    sketches = np.unique(run_sketches(*words_of(blocks), run))
                    held.setdefault((host, -(-parts // GROUP_PARTS)), []).append((key, part, sketches))
                    total += len(sketches) + 1
                    if total >= PACK_RUNS:
                        yield flush()
                        held, seen, total = {}, set(), 0
        yield flush()

    return on_several_pages(large.select("_host", "_part", "_parts", html).mapInArrow(cut, PACKS), np.uint32)


def shared_runs(blocks: DataFrame, sketches: DataFrame, run: int) -> DataFrame:
    """``on_several_pages`` of the runs whose sketches several pages have; ``blocks`` are the pages in their parts."""
    def pick(frame: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(packs) and len(frame):
            distinct = {page_key(row): row for row in map(unpack_blocks, frame["_page"])}
            sizes = [sum(block.count(" ") + 1 for block in row) for row in distinct.values()]
            words, codes = words_of([block for row in distinct.values() for block in row])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            whole = owner[run - 1:] == owner[:max(len(owner) - run + 1, 0)]
            shared = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in packs["hashes"]])
            hit = np.flatnonzero(np.isin(run_sketches(words, codes, run), shared) & whole)
            runs, page = run_hashes(words, codes, run)[hit], owner[hit]
            cuts = np.searchsorted(page, np.arange(len(sizes) + 1))
            part, groups = int(frame["_part"].iloc[0]), -(-int(frame["_parts"].iloc[0]) // GROUP_PARTS)
            rows = packs_of(frame["_host"].iloc[0], groups, [(key, part, runs[i:j]) for key, i, j in zip(distinct, cuts, cuts[1:])])
        return pd.DataFrame(rows, columns=PACK_NAMES)

    return on_several_pages(blocks.groupBy("_host", "_part").cogroup(sketches.groupBy("_host", "_part")).applyInPandas(pick, PACKS), np.uint64)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, url: str, html: str, run: int = RUN_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """``pages`` with ``html`` replaced by ``text``, the main text, and ``n_repeated``, words that other pages repeat.

    Blocks are joined by a line feed; white space inside one becomes a space. A null or empty page has an empty text; pages
    without a host form one. Rows with the same words are one page, whatever their URL or markup: copies do not make each
    other's text repeated, and each copy has its result. A host with more than ``part_bytes`` of markup is dealt over
    parts by a hash of the whole row, and its runs are compared by 64-bit hashes over all parts, so the result does not
    depend on ``part_bytes``; short sketches of all pages meet first, and only runs whose sketch recurs follow. Columns ``text`` and ``n_repeated`` are
    replaced.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_repeated", html)]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_repeated", T.LongType())])
    rows = pages.withColumn("_host", host_of(F.col(url)))
    parts = rows.groupBy("_host").agg(F.ceil(F.sum(F.coalesce(F.octet_length(html), F.lit(0)) + 1) / part_bytes).alias("_parts"))
    large = materialize(parts.filter("_parts > 1"))
    row_hash = F.xxhash64(*[F.col(c) for c in pages.columns if not isinstance(pages.schema[c].dataType, (T.MapType, T.VariantType))])
    rows = rows.join(large, "_host", "left").withColumn("_part", F.pmod(row_hash, F.coalesce("_parts", F.lit(1))))
    sketches = shared_sketches(rows.filter("_parts > 1"), html, run)
    carried = [*kept, "_host", "_part", "_parts"]
    cut_schema = T.StructType([rows.schema[c] for c in carried] + [
        T.StructField("_page", T.BinaryType()), T.StructField("_kinds", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                some = batch.slice(first, 1000)
                found = [blocks_of(page or "") for page in some.column(len(carried)).to_pylist()]
                packed = pa.array([pack_blocks(f[0]) for f in found], pa.binary()), pa.array([bytes(f[1]) for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns[:len(carried)], *packed], names=cut_schema.names)

    def choose(frame: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        pages = [unpack_blocks(page) for page in frame["_page"]]
        numbers = pd.factorize(pd.Series([" ".join(blocks) for blocks in pages], dtype=object))[0]
        words: dict[str, int] = {}
        streams, owners, counted = [], [], set()
        for number, blocks in zip(numbers, pages):
            if number in counted:
                continue
            counted.add(number)
            stream = np.fromiter((words.setdefault(w, len(words)) for block in blocks for w in block.split(" ")), dtype=np.int64)
            streams.append(stream)
            owners.append(np.full(len(stream), number, dtype=np.int64))
        tokens, owner = np.concatenate(streams), np.concatenate(owners)
        again = repeated_words(tokens, owner, run)
        if len(packs):
            runs = np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in packs["hashes"]])
            found = np.isin(run_hashes(list(words), tokens, run), runs) & (owner[run - 1:] == owner[:len(owner) - run + 1])
            covered = np.zeros(len(tokens) + 1, dtype=np.int64)
            np.add.at(covered, np.flatnonzero(found), 1)
            np.add.at(covered, np.flatnonzero(found) + run, -1)
            again |= np.cumsum(covered[:-1]) > 0
        starts = dict(zip(dict.fromkeys(numbers.tolist()), np.cumsum([0, *map(len, streams)]).tolist()))
        texts, repeated = [], []
        for number, blocks, kinds in zip(numbers, pages, frame["_kinds"]):
            at, lines, n, article = starts[number], [], 0, ARTICLE in kinds
            for block, kind in zip(blocks, kinds):
                size = block.count(" ") + 1
                marks = again[at:at + size]
                at += size
                n += int(marks.sum())
                if kind == ARTICLE:
                    lines.append(block)
                elif kind == OTHER and not article:
                    unique = block if not marks.any() else " ".join(w for w, m in zip(block.split(" "), marks) if not m)
                    if unique:
                        lines.append(unique)
            texts.append("\n".join(lines))
            repeated.append(n)
        return frame[kept].assign(text=texts, n_repeated=repeated)

    blocks = rows.select(*carried, html).mapInArrow(cut, cut_schema)
    shared = shared_runs(blocks, sketches, run)
    return blocks.groupBy("_host", "_part").cogroup(shared.groupBy("_host", "_part")).applyInPandas(choose, schema)
