"""Texts cut off by field limits or in transfer (problem 9).

Decided by, in this order, all of it counted over the whole corpus of different texts:

* remains: half a character, entity or tag, or a link text that the source put behind the cut;
* vocabulary trie: the final token is no known word but a proper prefix of known words ('word');
* length: the text does not end, at the very length, in characters or bytes, at which its source's
  texts pile up; the final token may then be a whole word by chance ('limit');
* continuation: away from any limit, the final words occur elsewhere, and there a sentence hardly
  ever ends after them, the longest context seen often enough deciding ('sentence').

Plan. ``documents`` is read twice: for one narrow row per document (hashes and lengths, no text) and for
the different texts, both written once. Texts are tokenised in Arrow batches; contexts are 64-bit
rolling hashes. Only contexts that may end some suspect text are counted: bitmaps over hash buckets, one
for each length of context and of a size that follows the suspects up to a fixed bound, tell (what
they let through in excess costs work, not exactness). Counts are added inside a batch, then inside a task,
before they are shuffled. The trie is a table of prefixes with the words below them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.session import durable

#: Longest context, in tokens.
ORDER = 7
#: A context decides if it was seen so often; a single token needs more.
SEEN, SEEN_ONE = 3, 30
#: Share of sentence ends after a context up to which the text must go on.
ENDS, ENDS_ONE = 0.2, 0.03
#: A length is a limit if so many texts have it, and so large a share of those up to WINDOW shorter.
PILE, PILE_SHARE, WINDOW = 4, 0.4, 30
#: Hash buckets of a bitmap (powers of two), at least and at most: at most ORDER times 4 MB reach the driver and go out to the tasks.
BUCKETS = 1 << 16, 1 << 25
#: What sources put behind a cut, and beginnings of entities.
LINKS = ["read more", "show all", "show more", "see more", "view more", "continue reading", "more", "mehr", "mehr lesen", "weiterlesen", "alles anzeigen", "lire la suite", "voir plus", "afficher plus", "plus", "leer más", "ver más", "mostrar más", "más", "続きを読む", "もっと見る", "すべて表示"]
BARE_LINKS = [x for x in LINKS if " " in x or x in ("weiterlesen", "続きを読む", "もっと見る", "すべて表示")]
ENTITIES = ["amp", "quot", "lt", "gt", "nbsp", "apos", "hellip", "ndash", "mdash", "euro", "copy", "auml", "ouml", "uuml", "szlig", "eacute", "egrave", "agrave", "ccedil", "ntilde", "#39", "#34", "#38", "#160", "#8217", "#x27"]

_CJK = "぀-ヿ㐀-鿿ｦ-ﾟ"
_TOKEN = re.compile(rf"[{_CJK}]|\d+(?:[.,]\d+)*|[^\W\d_{_CJK}]+(?:['’\-][^\W\d_{_CJK}]+)*\d*|[.!?。！？]+|[^\w\s]|_")
_END = re.compile(r"[.!?。！？]+$")
_CLOSERS = " \t\r\n　\"'”’»)）」』]*"
_LINK = re.compile(r"\s*(?:[\[(<…]\s*(?:\.\.\.\s*)?(?:" + "|".join(map(re.escape, LINKS)) + r")\s*[\])>»]*|(?<![\w])(?:\.\.\.\s*)?(?:" + "|".join(map(re.escape, BARE_LINKS)) + r")\s*[»>]*)\s*$", re.I)
_ELLIPSIS = re.compile(r"\s*(?:…|\.\.\.+|\[…\]|\[\.\.\.\])\s*$")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_HALF_TAG = re.compile(r"<[/!]?[a-zA-Z]?[^<>\s]{0,20}$")
_HALF_ENTITY = re.compile(r"&(#?\w{0,8})$")
_SYMBOL = re.compile(r"[☀-➿\U0001f000-\U0001faff️]$")
_ENTITY_STARTS = {e[:i] for e in ENTITIES for i in range(len(e) + 1)}


def tail(text: str) -> tuple[str, bool, bool, bool]:
    """(core, broken, link, ellipsis): the text without what was put behind a cut, and what was found there."""
    t = text.rstrip()
    half = _HALF_ENTITY.search(t)
    broken = t.endswith("�") or bool(half and half.group(1) in _ENTITY_STARTS) or bool(_HALF_TAG.search(t))
    core = html.unescape(_TAG.sub(" ", t)).rstrip()
    link = _LINK.search(core)
    if link:
        core = core[: link.start()].rstrip()
    dots = _ELLIPSIS.search(core)
    if dots:
        core = core[: dots.start()].rstrip()
    return core, broken, bool(link), bool(dots)


def ended(core: str) -> bool:
    """Whether a text closes with a final mark, a symbol, or such a mark inside closing quotes or brackets."""
    c = core.rstrip(_CLOSERS)
    return not c or bool(_END.search(c)) or bool(_SYMBOL.search(core.rstrip()))


def tokens(core: str) -> list[str]:
    return ["0" if w[0].isdigit() else w for w in _TOKEN.findall(core.lower())]


def contexts(lists: list[list[str]], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes (positions, ORDER), text number): hash of the last 1..ORDER tokens up to every position."""
    flat = []
    for toks in lists:
        flat.append(7)  # beginning of the text
        for w in toks:
            g = ids.get(w)
            if g is None:
                g = ids[w] = xxhash.xxh64_intdigest(w)
            flat.append(g)
    g = np.array(flat, np.uint64)
    of = np.repeat(np.arange(len(lists)), [len(t) + 1 for t in lists])
    out = np.empty((len(g), ORDER), np.uint64)
    with np.errstate(over="ignore"):
        out[:, 0] = g * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        for k in range(1, ORDER):
            prev = np.r_[np.uint64(0), out[:-1, k - 1]]
            prev[np.r_[True, of[1:] != of[:-1]]] = 0
            out[:, k] = (prev ^ (prev >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + out[:, 0] + np.uint64(k)
    return out, of


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_id, broken, link, ellipsis, ended, word, hashes) of every different text that may be cut."""
    ids: dict[str, int] = {}
    for b in batches:
        keep, lists, rows = [], [], []
        for i, t in enumerate(b.column("text").to_pylist()):
            core, broken, link, dots = tail(t)
            if not core.strip():
                continue
            end = ended(core)
            if end and not broken:
                continue
            keep.append(i)
            toks = tokens(core) or ["?"]
            lists.append(toks[-ORDER:] if len(toks) >= ORDER else toks)
            rows.append((broken, link, dots, end, toks[-1], len(toks) < ORDER))
        if not keep:
            continue
        hashes, of = contexts(lists, ids)
        last = np.flatnonzero(np.r_[of[1:] != of[:-1], True])
        yield pa.RecordBatch.from_arrays(
            [b.column("text_id").take(pa.array(keep)), *[pa.array([r[j] for r in rows]) for j in range(5)], _lists(hashes[last])],
            names=["text_id", "broken", "link", "ellipsis", "ended", "word", "h"],
        )


def _lists(h: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]), pa.array(np.ascontiguousarray(h).view(np.int64).ravel()))


def _evidence(asked: list[np.ndarray]):
    """Kernel: counts of contexts and words in every batch of different texts.

    Rows (k, g, word, n, ends, closes). k 1 to ORDER: context g of k tokens, how often, before how many
    sentence ends and how many ends of the text; only contexts that are marked in ``asked``, a bitmap over
    hash buckets for each k. k 0: in how many texts ``word`` stands with something after it.
    """
    schema = pa.schema([("k", pa.int32()), ("g", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("ends", pa.int64()), ("closes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        for b in batches:
            if len(ids) > 2_000_000:
                ids.clear()
            lists = [tokens(tail(t)[0]) for t in b.column("text").to_pylist()]
            if not lists:
                continue
            words: Counter[str] = Counter()
            for t in lists:
                words.update({w for w in t[:-1] if w[0].isalpha()})
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(words), np.int32)), pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()), *[pa.array(np.zeros(len(words), np.int64))] * 2], schema=schema)
            hashes, of = contexts(lists, ids)
            mark = np.array([m for t in lists for m in [False, *(bool(_END.search(w)) for w in t)]], bool)
            edge = of[1:] != of[:-1]
            final, first = np.r_[edge, True], np.r_[True, edge]
            follows = np.r_[mark[1:], False] & ~final
            use = ~mark & ~first
            for k in range(ORDER):
                bits = asked[k]
                key = hashes[:, k] & np.uint64(8 * len(bits) - 1)
                at = np.flatnonzero(use & (bits[key >> np.uint64(3)] >> (key & np.uint64(7)).astype(np.uint8) & 1).astype(bool))
                if not len(at):
                    continue
                g, where, n = np.unique(hashes[at, k], return_inverse=True, return_counts=True)
                ends, closes = (np.bincount(where, v[at], len(g)).astype(np.int64) for v in (follows, final))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k + 1, np.int32)), pa.array(g.view(np.int64)), pa.nulls(len(g), pa.string()), pa.array(n.astype(np.int64)), pa.array(ends), pa.array(closes)], schema=schema)

    return run


def _marked(suspects: DataFrame, buckets: int) -> list[np.ndarray]:
    """Per context length a bitmap, 8 buckets a byte, of the hash buckets of the suspects' endings; packed by the tasks."""

    def pack(key, g: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BUCKETS[0], np.uint8)
        bits[g["low"].to_numpy()] = 1
        return pd.DataFrame({"k": [key[0]], "part": [key[1]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    b = F.col("h").bitwiseAND(F.lit(buckets - 1))
    low = suspects.select(F.posexplode("h").alias("k", "h")).select("k", F.floor(b / BUCKETS[0]).cast("int").alias("part"), (b % BUCKETS[0]).cast("int").alias("low")).where("low is not null").distinct()
    out = [np.zeros(buckets // 8, np.uint8) for _ in range(ORDER)]
    width = BUCKETS[0] // 8
    for r in low.groupBy("k", "part").applyInPandas(pack, "k int, part int, bits binary").collect():  # at most ORDER * BUCKETS[1] / 8 bytes
        out[r.k][r.part * width : (r.part + 1) * width] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _narrow(documents: DataFrame, *keys: str) -> DataFrame:
    """``keys``, source, text_id, chars, bytes of every document with a text, empty or not."""
    return documents.where("text is not null").select(*keys, "source", F.xxhash64("text").alias("text_id"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))


def _limits(docs: DataFrame) -> DataFrame:
    texts = docs.where("bytes > 0").select("source", "text_id", "chars", "bytes").distinct()
    sizes = texts.select("source", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("chars", "bytes")])).alias("z"))
    per = sizes.groupBy("source", "z.unit", "z.size").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-WINDOW, -1)  # one row per source and length
    around = per.withColumn("_below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return around.where((F.col("n") >= PILE) & (F.col("n") >= PILE_SHARE * F.col("_below"))).select("source", "unit", F.col("size").alias("limit"))


def limits_of(documents: DataFrame) -> DataFrame:
    """(source, unit, limit): lengths at which a source's different texts pile up. Copies of a text count once."""
    return _limits(_narrow(documents))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason) of every document whose text was cut.

    reason, the first that holds: 'remains' (half a character, entity or tag), 'link', 'word' (unknown
    proper prefix of known words), 'limit' (no final mark at the very length at which the source's
    texts pile up), 'sentence' (its last words always go on). Texts that close with a final mark, that equal another
    document's title, or are null or empty are not cut. Repeated texts get one verdict. Null sources
    form a source of their own; rows without doc_id are left out; an empty table gives no rows; extra
    columns are ignored.
    """
    docs = durable(_narrow(documents.where("doc_id is not null"), "doc_id"))
    texts = durable(documents.where("doc_id is not null and text <> ''").groupBy(F.xxhash64("text").alias("text_id")).agg(F.min("text").alias("text")))
    sus = durable(texts.mapInArrow(_suspects, "text_id bigint, broken boolean, link boolean, ellipsis boolean, ended boolean, word string, h array<bigint>"))
    buckets = min(max(1 << (16 * sus.count()).bit_length(), BUCKETS[0]), BUCKETS[1])
    found = texts.select("text").mapInArrow(_evidence(_marked(sus, buckets)), "k int, g bigint, word string, n bigint, ends bigint, closes bigint")
    counts = found.groupBy("k", "g", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("closes").alias("closes"))
    counts = durable(counts.where((F.col("k") == 0) | (F.col("n") > 1)))  # a context seen once is the suspect's own
    wanted = sus.select("text_id", F.posexplode("h").alias("k", "g")).select("text_id", (F.col("k") + 1).alias("k"), "g")
    seen = counts.where("k > 0").drop("word")
    # the suspect's own end is no witness
    known = wanted.join(seen, ["k", "g"]).select("text_id", "k", (F.col("n") - 1).alias("n"), (F.col("ends") + F.col("closes") - 1).alias("ends"))
    known = known.where((F.col("n") >= F.when(F.col("k") == 1, SEEN_ONE).otherwise(SEEN)))
    best = known.groupBy("text_id").agg(F.max(F.struct("k", "n", "ends")).alias("b"))
    two = wanted.join(seen, ["k", "g"]).where("k = 2").select(F.col("text_id").alias("_t2"), (F.col("n") - 1).alias("pair_seen"))

    words = counts.where("k = 0").select("word", F.col("n").alias("texts"))
    trie = words.where("texts >= 2 and length(word) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("word"), "texts").groupBy("word").agg(F.sum("texts").alias("below"))
    finals = sus.select("word").distinct().join(words, "word", "left").join(trie, "word", "left")
    unknown = finals.where("coalesce(texts, 0) < 2 and below is not null").select(F.col("word").alias("_w"))
    verdict = sus.join(best, "text_id", "left").join(two, F.col("text_id") == F.col("_t2"), "left").join(unknown, F.col("word") == F.col("_w"), "left")
    titles = documents.where("title is not null").select(F.xxhash64("title").alias("_title")).distinct()
    verdict = verdict.join(titles, F.col("text_id") == F.col("_title"), "left_anti")
    goes_on = F.col("b.ends") <= F.col("b.n") * F.when(F.col("b.k") == 1, ENDS_ONE).otherwise(ENDS)
    word = F.col("_w").isNotNull() & (F.coalesce("pair_seen", F.lit(0)) == 0)
    verdict = verdict.select("text_id", "broken", "link", "ellipsis", "ended", F.coalesce(goes_on, F.lit(False)).alias("goes_on"), word.alias("half"))
    limits = _limits(docs)
    hit = docs.join(verdict, "text_id")
    sizes = hit.where("not ended").select("doc_id", "source", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("chars", "bytes")])).alias("z"))
    at = sizes.join(limits, sizes.source.eqNullSafe(limits.source) & (F.col("z.unit") == F.col("unit")) & (F.col("z.size") <= F.col("limit")) & (F.col("z.size") >= F.col("limit") - 1)).select(F.col("doc_id").alias("_d")).distinct()
    hit = hit.join(at, F.col("doc_id") == F.col("_d"), "left").withColumn("full", F.col("_d").isNotNull())
    reason = (
        F.when(F.col("broken"), "remains").when(F.col("ended"), F.lit(None)).when(F.col("link"), "link").when(F.col("half"), "word").when(F.col("full"), "limit").when(F.col("goes_on"), "sentence")
    )
    return hit.select("doc_id", "source", reason.alias("reason")).where("reason is not null").dropDuplicates(["doc_id"])


def truncation_rates(documents: DataFrame) -> DataFrame:
    """Per source: documents with text, cut ones, their share, and its length limit if it has one."""
    cut = truncated(documents).groupBy("source").agg(F.count(F.lit(1)).alias("cut"))
    all_ = documents.where("doc_id is not null and text is not null and text <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    top = limits_of(documents).groupBy("source").agg(F.max(F.when(F.col("unit") == "chars", F.col("limit"))).alias("limit_chars"), F.max(F.when(F.col("unit") == "bytes", F.col("limit"))).alias("limit_bytes"))
    out = all_.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").join(top.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return out.na.fill({"cut": 0}).withColumn("share", F.col("cut") / F.col("documents"))
