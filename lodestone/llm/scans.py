"""Problem 4: noise in text from scanned pages.

Method: the words of all lines are counted once, with the word before them. Common words form a vocabulary trie;
rare words are run through it by a generalised Levenshtein automaton whose edits are the confusions of a scanner
(one look-alike for another, at most ``MAX_EDITS`` in a word), so that the trie gives every word of the vocabulary
within that distance and no search is cut short. Candidates are ranked by frequency and by the words beside them.
Page furniture - running titles, footers, page marks - is found from where lines stand and on how many pages of the
file they recur; broken words are those whose joined form is a word (and whose hyphenated form is not the commoner).
``repaired`` removes the furniture, mends broken and misread words and reflows the lines into paragraphs.

A trie is built per share of the vocabulary inside tasks, never on the driver or by broadcast; suspects
are spread over tasks too, so neither side is bound by one task's memory.

Defined cases: null and empty texts have no lines; a page without a file is a file of its own; page numbers that are
null sort first; text without line breaks is one line; lines and texts of any length are taken whole; a table
without pages or questions gives no rows for it; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.runtime import cut

# What a scanner reads (second) for what is printed (first).
CONFUSIONS = (("e", "c"), ("n", "ri"), ("i", "!"), ("t", "f"), ("a", "@"), ("o", "0"), ("s", "5"), ("l", "1"), ("i", "1"), ("l", "|"), ("i", "|"), ("d", "cl"), ("u", "ii"), ("g", "9"), ("q", "9"), ("m", "rn"), ("rn", "m"), ("h", "b"), ("b", "6"), ("b", "8"), ("w", "vv"), ("z", "2"), ("h", "li"), ("s", "$"))

MAX_EDITS = 2
ODDS = 10  # how much commoner the printed word must be than what was read for it
SHARE = 200_000  # words of the vocabulary in one trie
SUSPECTS = 10_000  # suspects of one lexicon
TASKS = 10_000  # tasks that look for suspects
BLOCK = 1_000_000  # suspects, or pairs of words, looked for in one pass over the texts
HELD = 300_000  # words a task counts before it hands them on
ROWS = 5_000  # texts taken apart at once
EDGE = 3  # lines from the top or the bottom of a page where furniture stands

TOKEN = r"(?:(?<![^\W_])[@!$|](?=[^\W\d_]))?[^\W_](?:[\w@!$|'’]*[^\W_])?(?:[!|](?=[,;]))?[.?!:;]?"
INVISIBLE = r"[\u200b-\u200d\u2060\ufeff]"
PARTING = "\ua66e"  # a letter that keeps lines apart
HYPHEN_SIGNS = "-\xad\xac\u2010\u2011"
HYPHENS = r"[-\xad\xac\u2010\u2011]"
NUMBER = r"(?:[0-9lo]{1,6}|[ivxlc]{1,8})"
MARK_WORD = rf"^[\W_]*(?:ocr\s*)?(?:pages?|pg|p)\b[\s.:#-]*{NUMBER}(?:\s*(?:/|of|-)\s*{NUMBER})?[\W_]*$"
MARK_SIGNS = r"^\s*(?:[-–—~*•|<=\[({]+\s*[0-9lo]{1,6}\s*[-–—~*•|>=\])}]+|[0-9lo]{1,6}\s*/\s*[0-9lo]{1,6})\s*$"
MARK_ENDS = frozenset("0123456789loivxc-–—~*•|>=])}.:#'\"_")
NO_MARK = frozenset("abcdefghijkmnqrstuvwxyzABCDEFGHIJKMNQRSTUVWXYZ")  # no page mark begins so
MARK_BEGIN = r"(?iU)^[\W_]*(?:ocr\s*)?(?:p(?:ages?|g)?\b|[\W_0-9lo]*[0-9lo][\s\W_0-9lo]*$)"
BARE = rf"^\s*{NUMBER}\s*$"
LINE = "\x00"
FIGURE = r"(?<![\w@!$|/.-])(?=[0-9lo]*[0-9])(?=[0-9lo]*[lo])[0-9lo]{2,}(?![\w@!$|/-])"
INSIDE = r"(?<![\w@.])(?:[A-Z]?[a-z]{2,}[0159@!][a-z]+|[A-Z]?[a-z]+[0159@!][a-z]{2,}|[a-z]{4,}[0159]|[A-Z][a-z]{3,}[0159])(?![\w@.])"


def pages(extracted: DataFrame) -> DataFrame:
    file = F.coalesce("text_file_path", F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return extracted.where("page_text is not null and page_id is not null").select(F.lit("extracted_pages").alias("table_name"), F.col("page_id").alias("row_key"), file.alias("file"), F.coalesce("page_no", F.lit(-1)).alias("page_no"), F.col("page_text").alias("text"))


def questions(rows: DataFrame) -> DataFrame:
    return rows.where("question_text is not null and row_id is not null").select(F.lit("questions").alias("table_name"), F.col("row_id").alias("row_key"), F.lit(None).cast("string").alias("file"), F.lit(0).alias("page_no"), F.col("question_text").alias("text"))


class Reader:
    """Takes lines apart, in Python workers. Holds compiled patterns; made once per task."""

    def __init__(self) -> None:
        hyphens = HYPHENS
        self.token = re.compile(TOKEN)
        self.vanish = re.compile(INVISIBLE)
        self.memo: dict[str, list[str]] = {}
        self.tail = re.compile(rf"((?:[^\W_][\w@!]*-)*[\w@!]*[^\W\d_][\w@!]*)({hyphens})\s*$")
        self.head = re.compile(r"\s*([^\W\d_][\w@!]*|[@!0-9][^\W\d_]+)")
        self.word_mark, self.sign_mark, self.bare = re.compile(MARK_WORD), re.compile(MARK_SIGNS), re.compile(BARE)
        self.compound = re.compile(rf"[^\W\d_]+(?:-[^\W\d_]+)+(?!{hyphens})")
        self.number = re.compile(r"(?<![^\W\d_])(?:[0-9]+|[ivxl]+)(?![^\W\d_])")
        self.other = re.compile(r"[\W\d_]+")
        self.digit = re.compile("[0-9]")
        self.alone = re.compile(r"(?<!\w)[0-9lo]*[0-9][0-9lo]*(?!\w)")
        self.figure, self.inside = re.compile(FIGURE, re.I), re.compile(INSIDE)

    def plain(self, line: str) -> str:
        return line if line.isascii() else self.vanish.sub("", line)

    def chunks(self, line: str) -> list[str]:
        """What white space parts, without a chunk at the line's end that ends in a hyphen: it holds a piece of a word."""
        c = line.split()
        if c and c[-1][-1] in HYPHEN_SIGNS:
            c.pop()
        return c

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk, each with a closing mark if one follows. Remembered, for most chunks come again."""
        if chunk.isalpha() or (chunk[-1] in ".?!:;" and chunk[:-1].isalpha()):
            return [chunk]  # as the pattern would have it
        if chunk[-1] == "," and chunk[:-1].isalpha():
            return [chunk[:-1]]
        got = self.memo.get(chunk)
        if got is None:
            if len(self.memo) > HELD:
                self.memo.clear()
            c = chunk if chunk.isascii() else self.vanish.sub("", chunk).replace("\xad", "")
            got = self.memo[chunk] = self.token.findall(c)
        return got

    def marked(self, line: str, edge: bool) -> bool:
        if line[:1] in NO_MARK:
            return False
        low = line.strip().lower()
        return low[-1:] in MARK_ENDS and bool(self.word_mark.match(low) or edge and self.sign_mark.match(low))

    def titles(self, lines: list[str]) -> list[str]:
        """What running titles keep from page to page: no figures of their own, and look-alikes read as one character."""
        whole = "\n".join(lines).lower()
        if PARTING in whole and len(lines) > 1:
            return [t for x in lines for t in self.titles([x])]
        c = self.number.sub(" ", whole).replace(" | ", " ").translate(_FIGURES)
        for a, b in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("li", "h")):
            c = c.replace(a, b)
        c = c.translate(_LETTERS)
        if len(lines) == 1:
            return [self.other.sub(" ", c).strip()]
        return [x.strip() for x in self.other.sub(" ", c.replace("\n", f" {PARTING} ")).split(PARTING)]

    def figure_of(self, line: str) -> int | None:
        """The first number that stands by itself in a line, letters read for digits as digits."""
        if not self.digit.search(line):
            return None
        m = self.alone.search(line.lower())
        return int(m[0].translate(_DIGITS)) if m and len(m[0]) < 9 else None


_DIGITS = str.maketrans("lo", "10")
_FIGURES = str.maketrans("0!|1@569", "oiilasbg")
_LETTERS = str.maketrans("cfb", "eth")


def body_lines(text: str) -> list[tuple[int, str]]:
    """Lines that are not blank, with their numbers from 1."""
    return [(i, x) for i, x in enumerate(text.split("\n"), start=1) if not x.isspace() and x]


class Tokens:
    """The words of a batch of texts as flat arrays of numbers; chunks between blanks are taken apart once a task."""

    def __init__(self, reader: Reader):
        self.reader = reader
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {LINE: 0, "": -1}  # chunks; no chunk is what stands before a blank at the start
        self.number: dict[str, int] = {}  # words
        self.texts: list[str] = []  # of words
        self.raw = [LINE]
        # of chunks: their words one after the other and how many; capital at its start; a capital after it is within a sentence; ends in a hyphen; has one
        self.held, self.sizes, self.flags = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros((1, 4), dtype=bool)

    def _add(self, chunks: list[str]) -> None:
        number, texts = self.number, self.texts
        # most chunks are one word, perhaps with a mark behind it
        every = pa.array(chunks, pa.string())
        bare = pc.ascii_rtrim(every, ".?!:;,")
        marks = (pc.binary_length(every).to_numpy() - pc.binary_length(bare).to_numpy()).astype(np.int64)
        plain = pc.ascii_is_alpha(bare).to_numpy(zero_copy_only=False) & (marks <= 1)
        w, marks, ours = bare.filter(pa.array(plain)), marks[plain], every.filter(pa.array(plain))
        lower = pc.ascii_lower(w).dictionary_encode()
        mine = lower.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [x for x in mine if x not in number]
        number.update(zip(fresh, range(len(texts), len(texts) + len(fresh))))
        texts += fresh
        places = np.fromiter(map(number.__getitem__, mine), dtype=np.int64, count=len(mine))[lower.indices.to_numpy()]
        is_true = lambda x: x.to_numpy(zero_copy_only=False)
        capital = is_true(pc.ascii_is_upper(pc.utf8_slice_codeunits(w, 0, 1))) & is_true(pc.ascii_is_lower(pc.utf8_slice_codeunits(w, 1, 2)))
        within = is_true(pc.ascii_is_lower(w)) & ((marks == 0) | is_true(pc.ends_with(ours, ",")))
        singles = np.stack([capital, within, *np.zeros((2, len(w)), dtype=bool)], axis=1)
        ours, others = ours.to_numpy(zero_copy_only=False).tolist(), every.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist()
        held, sizes, flags = [], [], []
        for chunk in others:
            w = self.reader.words(chunk)
            for x in w:
                x = x.rstrip(".?!:;").lower() or x
                k = number.get(x)
                if k is None:
                    k = number[x] = len(texts)
                    texts.append(x)
                held.append(k)
            sizes.append(len(w))
            flags.append((bool(w) and w[0][0].isupper() and w[0][1:2].islower(), bool(w) and w[-1].islower() and w[-1].isalpha(), chunk[-1] in HYPHEN_SIGNS, "-" in chunk))
        for some in (ours, others):
            self.known.update(zip(some, range(len(self.raw), len(self.raw) + len(some))))
            self.raw += some
        self.held = np.concatenate([self.held, places, np.array(held, dtype=np.int64)])
        self.sizes = np.concatenate([self.sizes, np.ones(len(ours), dtype=np.int64), np.array(sizes, dtype=np.int64)])
        self.flags = np.concatenate([self.flags, singles, np.array(flags, dtype=bool).reshape(-1, 4)])

    def read(self, texts: pa.Array) -> None:
        """Sets ``chunk`` (numbers of chunks without those that are pieces of words), ``word``, and for both the line they
        stand in; per line its text and number; and whether it has anything (``filled``)."""
        if len(self.texts) > HELD:
            self.clear()
        marked = pc.replace_substring(pc.replace_substring(texts, LINE, " "), "\n", f" {LINE} ")
        coded = pc.utf8_split_whitespace(pc.binary_join_element_wise(marked, LINE, " ")).flatten().dictionary_encode()
        mine = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if fresh := [c for c in mine if c not in self.known]:
            self._add(fresh)
        at = np.fromiter(map(self.known.__getitem__, mine), dtype=np.int64, count=len(mine))[coded.indices.to_numpy()]
        at = at[at >= 0]
        flags, sizes = self.flags, self.sizes
        ends = np.flatnonzero(at == 0)
        line = np.cumsum(at == 0) - (at == 0)
        self.lines = pc.count_substring(texts, "\n").to_numpy().astype(np.int64) + 1
        self.text_of = np.repeat(np.arange(len(texts)), self.lines)
        self.line_no = np.arange(len(ends)) - np.repeat(np.cumsum(self.lines) - self.lines, self.lines) + 1
        self.filled = np.diff(ends, prepend=-1) > 1
        last = np.zeros(len(at), dtype=bool)
        last[ends[self.filled] - 1] = True
        kept = (at != 0) & ~(last & flags[at, 2])
        self.chunk, self.chunk_line = at[kept], line[kept]
        n = sizes[self.chunk]
        starts = (np.cumsum(sizes) - sizes)[self.chunk]
        upto = np.cumsum(n)
        self.word = self.held[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - n), n)]
        self.word_line = np.repeat(self.chunk_line, n)
        self.first = (upto - n)[n > 0]  # of each chunk that has words, the place of its first
        before = np.concatenate([[0], self.chunk[:-1]])
        fits = np.concatenate([[False], self.chunk_line[1:] == self.chunk_line[:-1]])
        self.named = (flags[self.chunk, 0] & flags[before, 1] & fits)[n > 0]

    def away(self, pages: np.ndarray) -> np.ndarray:
        """Per line whether it is away from the edges of its page; lines of other texts always are."""
        rank = np.cumsum(self.filled) - self.filled
        base = rank[np.cumsum(self.lines) - self.lines]
        total = np.bincount(self.text_of, self.filled, minlength=len(self.lines))
        k = rank - base[self.text_of]
        return ~pages[self.text_of] | ((k >= EDGE) & (total[self.text_of] - 1 - k >= EDGE))


def counted(texts: DataFrame) -> DataFrame:
    """Words with counts: ``word``, ``n``; ``named``, with a capital within a sentence; ``inner``, away from a page's edges;
    and whether it is a ``compound`` within a line. Counted per task first, so that a word of every line reaches the
    shuffle once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        tokens, sums, compounds = Tokens(reader), np.zeros((3, 0), dtype=np.int64), Counter()

        def flush() -> pa.RecordBatch:
            n = len(sums[0])
            return pa.RecordBatch.from_arrays([
                pa.array([*tokens.texts[:n], *compounds], pa.string()), *[pa.array(np.concatenate([sums[i], [*compounds.values()] if i == 0 else np.zeros(len(compounds))]).astype(np.int64)) for i in range(3)],
                pa.array(np.arange(n + len(compounds)) >= n),
            ], names=["word", "n", "named", "inner", "compound"])

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                if len(tokens.texts) > HELD:
                    yield flush()
                    tokens.clear()
                    sums, compounds = np.zeros((3, 0), dtype=np.int64), Counter()
                tokens.read(batch.column("text"))
                m = len(tokens.texts)
                sums = np.pad(sums, ((0, 0), (0, m - sums.shape[1])))
                away = tokens.away(np.asarray(batch.column("page")))
                sums[0] += np.bincount(tokens.word, minlength=m)
                sums[1] += np.bincount(tokens.word[tokens.first[tokens.named]], minlength=m)
                sums[2] += np.bincount(tokens.word, away[tokens.word_line], minlength=m).astype(np.int64)
                times = np.bincount(tokens.chunk, minlength=len(tokens.raw))
                for k in np.flatnonzero((times > 0) & tokens.flags[:, 3]).tolist():
                    for found in reader.compound.findall(tokens.raw[k].lower()):
                        parts = found.split("-")
                        compounds.update({f"{a}-{b}": int(times[k]) for a, b in zip(parts, parts[1:])})
        yield flush()

    each = texts.select("text", (F.col("table_name") == "extracted_pages").alias("page")).mapInArrow(run, "word string, n long, named long, inner long, compound boolean")
    return each.groupBy("word", "compound").agg(F.sum("n").alias("n"), F.sum("named").alias("named"), F.sum("inner").alias("inner"))


def pair_key(prev: Column, word: Column) -> Column:
    """A number for two neighbouring words; workers make the same one."""
    a = F.xxhash64(prev)
    return F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(F.xxhash64(word))


def pair_counts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``prev``, ``word``, ``n`` and ``inner`` (away from a page's edges) of the pairs of neighbours that are asked for.

    The keys of the pairs are broadcast in blocks of at most ``BLOCK``; each block is one pass over the texts."""
    asked = cut(asked.select("prev", "word", pair_key(F.col("prev"), F.col("word")).alias("key")).distinct())
    blocks = 1 + asked.count() // BLOCK
    got = None
    for i in range(blocks):
        keys = asked.where(F.pmod("key", F.lit(blocks)) == i).select("key").distinct().toPandas()["key"].to_numpy(dtype=np.int64)  # a block
        shared = texts.sparkSession.sparkContext.broadcast(np.sort(keys))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted, tokens = shared.value, Tokens(Reader())
            hashes, sums = np.zeros(0, dtype=np.uint64), np.zeros((2, len(wanted)), dtype=np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    tokens.read(batch.column("text"))
                    if len(tokens.word) < 2 or not len(wanted):
                        continue
                    if len(hashes) > len(tokens.texts):
                        hashes = hashes[:0]
                    more = np.array([xxhash.xxh64_intdigest(x, 42) for x in tokens.texts[len(hashes) :]], dtype=np.uint64)
                    hashes = np.concatenate([hashes, more])
                    h = hashes[tokens.word]
                    beside = tokens.word_line[1:] == tokens.word_line[:-1]
                    key = ((((h << np.uint64(1)) | (h >> np.uint64(63)))[:-1]) ^ h[1:]).view(np.int64)[beside]
                    place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    hit = wanted[place] == key
                    away = tokens.away(np.asarray(batch.column("page")))[tokens.word_line[1:][beside]]
                    sums[0] += np.bincount(place[hit], minlength=len(wanted))
                    sums[1] += np.bincount(place[hit & away], minlength=len(wanted))
            some = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["key", "n", "inner"])

        part = texts.select("text", (F.col("table_name") == "extracted_pages").alias("page")).mapInArrow(run, "key long, n long, inner long")
        got = part if got is None else got.union(part)
    return got.groupBy("key").agg(F.sum("n").alias("n"), F.sum("inner").alias("inner")).join(asked, "key").select("prev", "word", "n", "inner")


LAYOUT = (
    "table_name string, row_key long, file string, page_no int, edges array<struct<line_no:int,top:int,bottom:int,line:string,key:string,again:boolean,figure:int,explicit:boolean,bare:boolean>>, "
    "tails array<struct<line_no:int,tail:string,sign:string,after:array<struct<line_no:int,head:string>>>>, opens array<struct<line_no:int,head:string>>"
)


def layout(texts: DataFrame) -> DataFrame:
    """One row per page, and per question that has several lines or a mark: the lines at its edges and all page marks;
    the lines that end in a hyphen, each with the lines after it up to the first that can be nothing but body; and the
    lines from its top up to the first such line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        some_lines = pa.list_(pa.struct([("line_no", pa.int32()), ("head", pa.string())]))
        edge = pa.struct([("line_no", pa.int32()), ("top", pa.int32()), ("bottom", pa.int32()), ("line", pa.string()), ("key", pa.string()), ("again", pa.bool_()), ("figure", pa.int32()), ("explicit", pa.bool_()), ("bare", pa.bool_())])
        tail = pa.struct([("line_no", pa.int32()), ("tail", pa.string()), ("sign", pa.string()), ("after", some_lines)])
        schema = pa.schema([("table_name", pa.string()), ("row_key", pa.int64()), ("file", pa.string()), ("page_no", pa.int32()), ("edges", pa.list_(edge)), ("tails", pa.list_(tail)), ("opens", some_lines)])
        for batch in batches:
            if not batch.num_rows:
                continue
            pages = pc.equal(batch.column("table_name"), "extracted_pages").to_pylist()
            upto, cells, tails, opens = [0], tuple([] for _ in edge), [], []
            for page, text in zip(pages, batch.column("text").to_numpy(zero_copy_only=False).tolist()):
                lines = body_lines(text) if text.isascii() else [(i, reader.plain(x)) for i, x in body_lines(text)]
                m = len(lines)
                at_edge = [page and (k < EDGE or m - 1 - k < EDGE) for k in range(m)]
                explicit = [reader.marked(x, at_edge[k] or not page) for k, (_, x) in enumerate(lines)]

                def heads(k: int) -> list[dict]:
                    """Lines from k on, up to the first that is sure to be body."""
                    got = []
                    for j in range(k, m):
                        h = reader.head.match(lines[j][1])
                        got.append({"line_no": lines[j][0], "head": h[1] if h else ""})
                        if not at_edge[j] and not explicit[j]:
                            break
                    return got

                mine = []
                for k, (no, line) in enumerate(lines):
                    t = reader.tail.search(line.split()[-1]) if line.rstrip()[-1:] in HYPHEN_SIGNS and line.strip() else None
                    if t:
                        mine.append({"line_no": no, "tail": t[1], "sign": t[2], "after": heads(k + 1)})
                tails.append(mine)
                opens.append(heads(0) if page else [])
                some = [k for k in range(m) if at_edge[k] or explicit[k]]
                bare = [page and len(x := lines[k][1].strip()) <= 8 and bool(reader.bare.match(x.lower())) for k in some]
                keyed = [j for j, k in enumerate(some) if page and not explicit[k] and not bare[j]]
                keys = dict(zip(keyed, reader.titles([lines[k][1] for k in map(some.__getitem__, keyed)]))) if keyed else {}
                met = set()
                for j, k in enumerate(some):
                    no, line = lines[k]
                    key = keys.get(j, "")
                    row = (no, k, m - 1 - k, line, key, key in met, reader.figure_of(line) if key else None, explicit[k], bare[j])
                    for cell, x in zip(cells, row):
                        cell.append(x)
                    met.add(key)
                upto.append(upto[-1] + len(some))
            edges = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cells, edge)], fields=list(edge)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(schema.field(c).type) for c in ("table_name", "row_key", "file", "page_no")], edges, pa.array(tails, pa.list_(tail)), pa.array(opens, some_lines)], names=schema.names)

    # a question of one line has no broken words, and one that does not begin like a page mark stays out of the workers
    lined = (F.col("table_name") == "extracted_pages") | F.col("text").contains("\n") | F.col("text").rlike(MARK_BEGIN)
    return texts.where(lined).mapInArrow(run, LAYOUT)


def _codes(words: list[str]) -> np.ndarray:
    """The code points of words, a row each, with zeros behind them."""
    width = max(map(len, words), default=0)
    return np.array(words, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(words), max(width, 1))[:, :width]


class Trie:
    """Words as levels of nodes in flat arrays: of level d the characters, where each node's children begin on the next
    level and how many they are, and the place in the list of the word that ends there (-1 where none does)."""

    def __init__(self, at: np.ndarray, lens: np.ndarray, alphabet: np.ndarray):
        """Of words as numbers of characters of an alphabet, a row each, with zeros behind them."""
        self.alphabet, width = alphabet, int(lens.max(initial=0))
        at = at[:, :width]
        order = np.lexsort(at.T[::-1]) if width else np.arange(len(at))
        at, lens = at[order], lens[order]
        new = np.zeros(len(at), dtype=bool)
        new[:1] = True
        self.char, self.first, self.many, self.word = [np.zeros(1, dtype=np.int64)], [], [], [np.full(1, -1)]
        node, live = np.zeros(len(at), dtype=np.int64), np.arange(len(at))
        for d in range(width):
            changed = np.concatenate([[True], at[1:, d] != at[:-1, d]]) if len(at) else new
            new = new | changed
            here = live[lens[live] > d]
            # a node begins where the prefix differs from that of the word before
            begins = new[here]
            number = np.cumsum(begins) - 1
            heads = here[begins]
            many = np.bincount(node[heads], minlength=len(self.char[d]))
            self.first.append(np.cumsum(many) - many)
            self.many.append(many)
            self.char.append(at[heads, d])
            ends = np.full(len(heads), -1)
            over = lens[here] == d + 1
            ends[number[over]] = order[here[over]]
            self.word.append(ends)
            node[here], live = number, here
        self.first.append(np.zeros(len(self.char[-1]), dtype=np.int64))
        self.many.append(np.zeros(len(self.char[-1]), dtype=np.int64))


MERGED = tuple((read, printed) for printed, read in CONFUSIONS if len(read) == 2 and len(printed) == 1)
PARTED = tuple((read, printed) for printed, read in CONFUSIONS if len(read) == 1 and len(printed) == 2)


def _run(trie: Trie, words: list[str], gates: list[int], merged: list[str], parted: list[tuple[str, str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levenshtein automata of some words of one length run through a trie side by side: arrays of word number, number of
    the trie's word, and edits. A state is a set of places in the word for each number of edits, a bit a place, so that a
    step is a few operations on whole arrays; with so many edits a word may only be at the places of the gate for that number."""
    most, n = len(gates) - 1, len(words[0])
    bits = np.uint16 if n < 16 else np.uint32 if n < 32 else np.uint64  # less to move for most words
    one, gates = bits(1), [bits(g) for g in gates]
    alphabet = {chr(c): i for i, c in enumerate(trie.alphabet)}
    split = [(alphabet.get(p[0], -1), alphabet.get(p[1], -1)) for _, p in parted]
    at = _codes(words)
    known = np.searchsorted(trie.alphabet, at)
    known[trie.alphabet[np.minimum(known, len(alphabet) - 1)] != at] = len(alphabet)
    mask = np.zeros((len(words), len(alphabet) + 1), dtype=bits)
    merge = np.zeros(len(words), dtype=bits)
    read = np.zeros((len(split), len(words)), dtype=bits)
    every = np.arange(len(words))
    for k in range(n):
        place = bits(1 << k)
        mask[every, known[:, k]] |= place
        if k + 1 < n:
            for a, b in merged:
                merge[(at[:, k] == ord(a)) & (at[:, k + 1] == ord(b))] |= place
        for j, (r, _) in enumerate(parted):
            read[j, at[:, k] == ord(r)] |= place
    flat, wide = mask.ravel(), mask.shape[1]
    # state: word, node, the character before, and places after 0, 1 .. edits, now and one character earlier
    who = every.astype(np.int32)
    node, char = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1)
    now = [np.ones(len(words), dtype=bits) & gates[0]]
    for k in range(1, most + 1):
        now.append((now[-1] | (now[-1] << one)) & gates[k])
    old = [np.zeros_like(x) for x in now]
    parts = np.bitwise_or.reduce(read, axis=0)
    for d in range(len(trie.char) - 1):
        free = np.zeros_like(now[0])
        for k in range(most):
            x = now[k]
            free |= (x | x << one | x << bits(2) | (old[k] & parts[who]) << one) & gates[k + 1]
        spent = free == 0
        # where all edits are spent, or none can be made yet, only a child with the very next character lives
        rows, child = _children(trie, d, node, np.flatnonzero(spent))
        c, i = trie.char[d + 1][child], who[rows]
        m = flat[i * wide + c]
        was = [x[rows] for x in now]
        got = [((x & m) << one) & g for x, g in zip(was, gates)]
        on = np.flatnonzero(np.bitwise_or.reduce(got))
        exact = (i[on], child[on], c[on], [x[on] for x in got], [x[on] for x in was])
        rows, child = _children(trie, d, node, np.flatnonzero(~spent))
        if not len(rows) and not len(on):
            break
        c, i = trie.char[d + 1][child], who[rows]
        m = flat[i * wide + c]
        was = [x[rows] for x in now]
        got = [((was[0] & m) << one) & gates[0]]
        merging = merge[i]
        two = [np.flatnonzero((c == b) & (char[rows] == a)) for a, b in split]
        for k in range(1, most + 1):
            # kept, added, put for another, left out, two read for one
            less = was[k - 1]
            r = (((was[k] & m) | less | got[-1]) << one) | less | got[-1] | ((less & merging) << bits(2))
            for j, t in enumerate(two):  # one read for two
                if len(t):
                    r[t] |= (old[k - 1][rows[t]] & read[j, i[t]]) << one
            r &= gates[k]
            got.append(r)
        alive = got[-1].copy()
        for x in got[:-1]:
            alive |= x
        alive = np.flatnonzero(alive)
        joined = lambda a, b: np.concatenate([a[alive], b])
        who, node, char = joined(i, exact[0]), joined(child, exact[1]), joined(c, exact[2])
        old, now = [joined(a, b) for a, b in zip(was, exact[4])], [joined(a, b) for a, b in zip(got, exact[3])]
        v = trie.word[d + 1][node]
        end = np.flatnonzero(v >= 0)
        edits = np.full(len(end), most + 1)
        for k in range(most, -1, -1):
            edits[((now[k][end] >> bits(n)) & one) == 1] = k
        met = end[edits <= most]
        yield who[met], v[met], edits[edits <= most]


def _children(trie: Trie, d: int, node: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of some of the nodes of level ``d``: which of the nodes they are of, and their numbers."""
    many = trie.many[d][node[of]]
    upto = np.cumsum(many)
    start = trie.first[d][node[of]] - (upto - many)
    return np.repeat(of, many), np.arange(upto[-1] if len(upto) else 0) + np.repeat(start, many)


class Lexicon:
    """A vocabulary, and for each length of word that is looked for two tries of those of its words that may be near by
    their length: one forward, one backward."""

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        self.lens = np.array([len(w) for w in self.words], dtype=np.int64)
        self.alphabet, at = np.unique(np.append(_codes(self.words).ravel(), np.uint32(0)), return_inverse=True)
        self.at = at[:-1].astype(np.int32).reshape(len(self.words), -1) if self.lens.any() else np.zeros((len(self.words), 0), dtype=np.int32)

    def within(self, words: list[str], group: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of word number, number of the vocabulary's word, and edits, of every pair within two edits (one edit for a word of
        four characters and fewer); two characters read for one of the scanner's, or one for two, are one edit.

        Complete for words of up to 60 characters: no edit changes a length by more than one; and of two edits either at
        most one is in the first half of the word, and the forward trie has the pair without a second edit there, or both
        are, and the backward trie has it behind an exact second half."""
        merged = [r for r, _ in MERGED]
        of_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            of_length.setdefault(len(w), []).append(i)
        for n, all_these in of_length.items():
            most = 2 if n > 4 else 1
            number = np.flatnonzero(abs(self.lens - n) <= most)
            if not len(number):
                continue
            at, lens = self.at[number], self.lens[number]
            from_end = lens[:, None] - 1 - np.arange(at.shape[1])
            turned = np.where(from_end >= 0, np.take_along_axis(at, np.maximum(from_end, 0), axis=1), 0)
            ahead, back = Trie(at, lens, self.alphabet), Trie(turned, lens, self.alphabet) if most == 2 else None
            full, half = (1 << (n + 1)) - 1, (n + 1) // 2
            late, gate = full & ~((1 << half) - 1), full & ~((1 << (n - half)) - 1)
            for start in range(0, len(all_these), group):
                these = np.array(all_these[start : start + group])
                part = [words[i] for i in these]
                got = list(_run(ahead, part, [full, full, late][: most + 1], merged, list(PARTED)))
                if back:
                    got += _run(back, [w[::-1] for w in part], [full, gate, gate], [r[::-1] for r in merged], [(r, p[::-1]) for r, p in PARTED])
                if got:
                    i, v, e = (np.concatenate(x) for x in zip(*got))
                    by = np.lexsort((e, v, i))
                    i, v, e = i[by], v[by], e[by]
                    new = np.concatenate([[True], (i[1:] != i[:-1]) | (v[1:] != v[:-1])])[: len(i)]
                    yield these[i[new]], number[v[new]], e[new]


OTHER_EDIT = 3  # what an edit that is no confusion of a scanner costs; a confusion costs 1


def cost(word: str, v: str, most: int = 99) -> int:
    """The cheapest way to read ``v`` as ``word``: confusions at 1, single other edits at ``OTHER_EDIT``; ``most`` + 1 where
    it costs more than ``most``."""
    n, m, best = len(word), len(v), most + 1
    stack, met = [(0, 0, 0)], {}
    while stack:
        i, j, c = stack.pop()
        if c >= best or met.get((i, j), 99) <= c:
            continue
        met[i, j] = c
        if i == n and j == m:
            best = c
            continue
        if c + 1 < best and i < n:
            for r, p in RULES.get(word[i], ()):
                if word.startswith(r, i) and v.startswith(p, j):
                    stack.append((i + len(r), j + len(p), c + 1))
        if c + OTHER_EDIT < best:
            stack += [(i + 1, j, c + OTHER_EDIT)] * (i < n) + [(i, j + 1, c + OTHER_EDIT)] * (j < m) + [(i + 1, j + 1, c + OTHER_EDIT)] * (i < n and j < m)
        if i < n and j < m and word[i] == v[j]:
            stack.append((i + 1, j + 1, c))
    return best


RULES: dict[str, list[tuple[str, str]]] = {}
for _printed, _read in CONFUSIONS:
    RULES.setdefault(_read[0], []).append((_read, _printed))


def _letters(words: list[str]) -> np.ndarray:
    """Which characters words have, a bit each (some share one)."""
    got, at = np.zeros(len(words), dtype=np.uint64), _codes(words).astype(np.uint64)
    for c in at.T:
        got |= np.where(c > 0, np.uint64(1) << (c & np.uint64(63)), np.uint64(0))
    return got


PRINTED, READ = (_letters([x[i] for x in CONFUSIONS]).tolist() for i in (0, 1))


def _usable(letters: np.ndarray, needed: list[int]) -> np.ndarray:
    """For which confusions words have all characters, a bit each."""
    got = np.zeros(len(letters), dtype=np.uint32)
    for k, x in enumerate(needed):
        got |= (letters & np.uint64(x) == np.uint64(x)).astype(np.uint32) << np.uint32(k)
    return got


def _possible(read: tuple[np.ndarray, np.ndarray], printed: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs may differ by confusions alone: a character that only one of the two has is of a confusion both
    have the characters for."""
    a, b = read[0][i], printed[0][j]
    usable = read[1][i] & printed[1][j]
    a, b = a & ~b, b & ~a
    for k, (p, r) in enumerate(zip(PRINTED, READ)):
        on = (usable >> np.uint32(k) & np.uint32(1)).astype(np.uint64)
        a, b = a & ~(on * np.uint64(r)), b & ~(on * np.uint64(p))
    return (usable > 0) & (a | b == 0)


def _search(key, vocabulary: pd.DataFrame, suspects: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(vocabulary) and len(suspects):
        often = dict(zip(vocabulary.v, vocabulary.nv))
        least = dict(zip(suspects.w, suspects.nw * ODDS))
        short = [w for w in suspects.w if len(w) <= 60]
        # only what is much commoner can be the word that was printed
        lowest = min(least.values())
        lexicon = Lexicon([v for v, n in often.items() if len(v) <= 62 and n >= lowest])
        nv, nw = np.array([often[v] for v in lexicon.words]), np.array([least[w] for w in short])
        read, printed = ((x, _usable(x, needed)) for x, needed in ((_letters(short), READ), (_letters(lexicon.words), PRINTED)))
        pairs = []
        for i, j, e in lexicon.within(short):
            fit = (e > 0) & (nv[j] >= nw[i])
            i, j = i[fit], j[fit]
            fit = _possible(read, printed, i, j)
            pairs += [(short[x], lexicon.words[y]) for x, y in zip(i[fit].tolist(), j[fit].tolist())]
        pairs += [(w, v) for w in suspects.w if len(w) > 60 for v in often if abs(len(v) - len(w)) <= MAX_EDITS and v != w and often[v] >= least[w]]
        out = [(w, v, c) for w, v in pairs if (c := cost(w, v, MAX_EDITS)) <= MAX_EDITS]
    return pd.DataFrame(out, columns=["w", "v", "edits"])


def candidates(words: DataFrame, least: int = 5, odds: int = ODDS) -> DataFrame:
    """``w``, ``v``, ``edits``, ``nw``, ``nv``: words that may be misread, and the much commoner words they may be.

    A name (a capital within sentences in most of its places) is no suspect unless a sign or figure stands among its letters.
    """
    in_vocabulary = (F.col("n") >= least) & F.col("word").rlike(r"^[\p{L}'’]{2,}$")
    vocabulary = words.where(in_vocabulary).select(F.col("word").alias("v"), F.col("n").alias("nv"))
    odd = F.col("word").rlike(r"\p{L}") & F.col("word").rlike(r"[0-9@!$|]")
    letters = F.col("word").rlike(r"^[\p{L}'’]+$") & (F.col("named") * 2 < F.col("n")) & (F.length("word") >= 3)
    marked = F.col("word").rlike("|".join(sorted({r for _, r in CONFUSIONS if r.isalpha()})))
    ordinal = F.col("word").rlike(r"^[0-9]+(st|nd|rd|th|s|k|m|am|pm)?$")
    top, many = words.agg(F.max("n"), F.count_if(in_vocabulary)).first()  # two numbers
    top = top or 0
    suspects = words.where((odd & ~ordinal | letters & marked) & (F.col("n") * odds <= F.lit(top))).select(F.col("word").alias("w"), F.col("n").alias("nw"))
    suspects = cut(suspects)
    shares = max(1, -(-many // SHARE))
    parts = max(1, -(-suspects.count() // SUSPECTS))
    # every suspect meets every share of the vocabulary once; a share is one trie, whatever the words' lengths
    left = vocabulary.where(F.col("nv") >= odds).select("v", "nv").withColumn("share", F.pmod(F.xxhash64("v"), F.lit(shares))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = suspects.select("w", "nw").withColumn("part", F.pmod(F.xxhash64("w"), F.lit(parts)).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    # a number of its own, or the few bytes of it would all be put into one task
    tasks = min(int(parts * shares), TASKS)
    left, right = left.repartition(tasks, "share", "part"), right.repartition(tasks, "share", "part")
    met = left.groupBy("share", "part").cogroup(right.groupBy("share", "part")).applyInPandas(_search, "w string, v string, edits int")
    return met.join(suspects, "w").join(vocabulary.select("v", "nv"), "v").where(F.col("nv") >= F.col("nw") * odds)


def places(texts: DataFrame, suspects: list[str]) -> DataFrame:
    """Where suspects stand: ``table_name``, ``row_key``, ``line_no``, ``prev``, ``next``, ``w``; and, with a null ``w``, lines
    with a letter read for a digit in a figure (``7l``, ``l67``) or a figure or sign among the letters of any word."""
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(suspects))  # one block, of at most BLOCK words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, wanted = Reader(), shared.value
        tokens, is_suspect, is_odd = Tokens(reader), np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
        none = pa.scalar(None, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                tokens.read(batch.column("text"))
                if len(is_suspect) > len(tokens.texts) or len(is_odd) > len(tokens.raw):
                    is_suspect, is_odd = is_suspect[:0], is_odd[:0]
                is_suspect = np.concatenate([is_suspect, np.array([w in wanted for w in tokens.texts[len(is_suspect) :]], dtype=bool)])
                more = [not c.isalpha() and not (c[-1] in ".?:;," and c[:-1].isalpha()) and bool(reader.figure.search(p := reader.plain(c)) or reader.inside.search(p)) for c in tokens.raw[len(is_odd) :]]
                is_odd = np.concatenate([is_odd, np.array(more, dtype=bool)])
                texts, none_beside = tokens.texts, len(tokens.texts)
                words = lambda k: pa.array([texts[x] if x < none_beside else "" for x in k.tolist()], pa.string())
                hit = np.flatnonzero(is_suspect[tokens.word])
                odd = np.unique(tokens.chunk_line[is_odd[tokens.chunk]])
                line, last = tokens.word_line, len(tokens.word)
                beside = lambda k: np.where((k >= 0) & (k < last) & (line[np.clip(k, 0, max(last - 1, 0))] == line[hit]), tokens.word[np.clip(k, 0, max(last - 1, 0))], none_beside) if len(hit) else hit
                where = np.concatenate([line[hit], odd])
                text_of = pa.array(tokens.text_of[where])
                empty = pa.array([""] * len(odd), pa.string())
                joined = lambda k: pa.concat_arrays([words(k), empty])
                found = pa.concat_arrays([words(tokens.word[hit]), pa.array([None] * len(odd), none.type)])
                yield pa.RecordBatch.from_arrays([batch.column("table_name").take(text_of), batch.column("row_key").take(text_of), pa.array(tokens.line_no[where].astype(np.int32)), joined(beside(hit - 1)), joined(beside(hit + 1)), found], names=["table_name", "row_key", "line_no", "prev", "next", "w"])

    return texts.select("table_name", "row_key", "text").mapInArrow(run, "table_name string, row_key long, line_no int, prev string, next string, w string")


def suspected(words: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places of suspects with what they may be (``v``, ``edits``, ``nw``, ``nv``), and the odd lines."""
    found = cut(candidates(words))
    blocks = 1 + found.count() // BLOCK
    seen_at = None
    for b in range(blocks):  # one unless there are more than BLOCK candidates
        part = places(texts, [r.w for r in found.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == b).select("w").distinct().collect()])
        seen_at = part if seen_at is None else seen_at.union(part)
    seen_at = cut(seen_at)
    return cut(seen_at.join(found, "w")), seen_at.where("w is null").select("table_name", "row_key", "line_no").distinct()


def beside(at: DataFrame) -> DataFrame:
    """The pairs of neighbours (``prev``, ``word``) that would stand at the places if the words were what they may be."""
    return at.select("prev", F.col("v").alias("word")).union(at.select(F.col("v").alias("prev"), F.col("next").alias("word"))).where("prev <> '' and word <> ''").distinct()


def corrections(at: DataFrame, odd: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per place of a suspect the word it most likely is: ``table_name``, ``row_key``, ``line_no``, ``w``, ``v``; odd lines with nulls.

    Ranked by the cost of the confusions, neighbours seen together elsewhere, and frequency. A word that differs from a
    real word by one letter for another (c for e, f for t, b for h, m for rn) and that is not far rarer needs a
    neighbour's support.
    """
    seen = pairs.select("prev", "word", "n")
    a = seen.select("prev", F.col("word").alias("v"), F.col("n").alias("na"))
    b = seen.select(F.col("prev").alias("v"), F.col("word").alias("next"), F.col("n").alias("nb"))
    judged = at.join(a, ["prev", "v"], "left").join(b, ["v", "next"], "left")
    support = F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0))
    sure = F.col("w").rlike(r"[0-9@!$|]") | F.col("w").rlike("ii|vv") | ((F.length("w") >= 5) & (F.col("nv") >= F.col("nw") * 50) & (F.col("edits") == 1))
    fit = judged.withColumn("support", support).where((F.col("support") > 0) | sure)
    best = fit.groupBy("table_name", "row_key", "line_no", "w").agg(F.max_by("v", F.struct(-F.col("edits"), F.least("support", F.lit(3)), "nv", "v")).alias("v"))
    return best.union(odd.select("*", F.lit(None).cast("string").alias("w"), F.lit(None).cast("string").alias("v")))


def page_lines(laid: DataFrame) -> DataFrame:
    """The lines at the edges of pages and the page marks, a row each."""
    return laid.where("table_name = 'extracted_pages'").select("row_key", "file", "page_no", F.explode("edges").alias("e")).select("row_key", "file", "page_no", "e.*")


def repeated(edges: DataFrame) -> DataFrame:
    """What may be running titles, per ``file`` and ``key``: lines at the edges of several of its pages, with ``on`` (pages),
    ``times`` and two wordings, ``lo`` and ``hi``. A number on a title must run on with the pages, as sums under tables do not."""
    keyed = edges.where("key <> ''").groupBy("file", "key", (F.col("figure") - F.col("page_no")).alias("offset")).agg(F.count_if(~F.col("again")).alias("pages"), F.count(F.lit(1)).alias("times"), F.min("line").alias("lo"), F.max("line").alias("hi"))
    step = F.bool_or(F.col("offset").isNull() | (F.col("pages") >= 2))
    per_file = keyed.groupBy("file", "key").agg(F.sum("pages").alias("on"), F.sum("times").alias("times"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), step.alias("step"))
    return per_file.where("step and on >= 2").drop("step")


def title_words(titles: DataFrame) -> DataFrame:
    """Per ``key`` and wording (``line``) its pairs of neighbouring words (``prev``, ``word``); of one word alone, that, with
    a null ``prev``. Two wordings, so that a misread one, whose words are rare, does not speak for all."""
    token = TOKEN.replace(r"[^\W_]", r"[\p{L}\p{N}]").replace(r"[^\W\d_]", r"\p{L}").replace(r"\w", r"\p{L}\p{N}")
    t = F.transform(F.regexp_extract_all("line", F.lit("(" + token + ")"), 1), lambda x: F.lower(F.rtrim(x, F.lit(".?!:;"))))
    letters = lambda x: x.rlike(r"\p{L}{2}") | x.isin("a", "i")
    lines = titles.select("key", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("line")).distinct().select("key", "line", t.alias("t")).withColumn("w", F.filter("t", letters))
    one = lines.where(F.size("w") == 1).select("key", "line", F.lit(None).cast("string").alias("prev"), F.col("w")[0].alias("word"))
    each = F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("prev"), F.slice("t", 2, F.size("t")).alias("word")))
    several = lines.where(F.size("w") > 1).withColumn("p", each).select("key", "line", "p.prev", "p.word").where(letters(F.col("prev")) & letters(F.col("word")))
    return several.union(one)


def apart(titles: DataFrame, parts: DataFrame, pairs: DataFrame, words: DataFrame, pages: DataFrame, most: float = 0.01) -> DataFrame:
    """``key`` of those titles that have two neighbouring words (or, of one word, that) which hardly meet away from the
    edges of pages: per page of the corpus at most ``most`` times as often as the title stands on the pages of its files.

    A line of body text that happens to open two pages is made of pairs of words that all stand everywhere in the body.
    """
    total = pages.agg(F.sum("pages").alias("whole"))
    stands = titles.join(pages, "file").groupBy("key").agg((F.sum("times") / F.sum("pages")).alias("stands"))
    two = parts.where("prev is not null").join(pairs.select("prev", "word", "inner"), ["prev", "word"], "left").select("key", "line", "inner")
    alone = parts.where("prev is null").select("key", "line", "word").join(words.select("word", "inner"), "word", "left").select("key", "line", "inner")
    rate = two.union(alone).groupBy("key", "line").agg(F.min(F.coalesce("inner", F.lit(0))).alias("inner")).groupBy("key").agg(F.max("inner").alias("inner"))
    return rate.join(stands, "key").crossJoin(F.broadcast(total)).where(F.col("inner") / F.col("whole") <= F.col("stands") * most).select("key")  # one row


def furniture(laid: DataFrame, edges: DataFrame, titles: DataFrame, keys: DataFrame) -> DataFrame:
    """Header and page number lines: ``table_name``, ``row_key``, ``line_no``, ``kind``; titles are those of ``keys``."""
    marks = laid.where("table_name = 'questions'").select("table_name", "row_key", F.explode("edges").alias("e")).where("e.explicit")
    in_questions = marks.select("table_name", "row_key", "e.line_no", F.lit("page_number").alias("kind"))
    titles = titles.join(keys, "key").select("file", "key", F.lit(True).alias("title"))
    told = edges.join(titles, ["file", "key"], "left").withColumn("title", F.coalesce("title", F.lit(False)))
    # a bare figure is a page number only if nothing but furniture is outside it
    plain = (~F.col("title") & ~F.col("explicit")).cast("int")
    by_page = W.partitionBy("row_key").orderBy("top")
    above = F.coalesce(F.sum(plain).over(by_page.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = F.coalesce(F.sum(plain).over(by_page.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    outer = cut(told.withColumn("outer", ((F.col("top") < EDGE) & (above == 0)) | ((F.col("bottom") < EDGE) & (below == 0))))
    digits = F.translate(F.lower(F.trim("line")), "lio", "110").try_cast("int")
    bare = outer.where("bare and not explicit and outer").withColumn("offset", digits - F.col("page_no"))
    support = bare.where("offset is not null").groupBy("file", "offset").agg(F.count_distinct("row_key").alias("pages"))
    best = support.groupBy("file").agg(F.max("pages").alias("most"))
    agreed = bare.join(support, ["file", "offset"], "left").join(best, "file", "left")
    numbers = agreed.where(F.col("offset").isNull() | (F.col("pages") >= 2) | (F.col("most") == 1))
    kinds = outer.where("explicit").select("row_key", "line_no", F.lit("page_number").alias("kind")).union(outer.where("title and not explicit").select("row_key", "line_no", F.lit("header").alias("kind"))).union(numbers.select("row_key", "line_no", F.lit("page_number").alias("kind")))
    return kinds.distinct().select(F.lit("extracted_pages").alias("table_name"), "row_key", "line_no", "kind").union(in_questions)


def broken_words(laid: DataFrame, kinds: DataFrame, compounds: DataFrame, words: DataFrame, bucket_pages: int = 256) -> DataFrame:
    """Lines that end in the first piece of a word: ``table_name``, ``row_key``, ``line_no``, ``a``, ``b``, ``next_key``, ``next_line``.

    The piece that follows is at the start of the next body line, perhaps on the file's next page that has body text.
    A file's pages are looked through by buckets, so that a file of very many pages is no single task.
    """
    gone = kinds.groupBy("table_name", "row_key").agg(F.collect_set("line_no").alias("gone"))  # at most a page's lines
    none = F.array().cast("array<int>")
    known = laid.select("table_name", "row_key", "file", "page_no", "tails", "opens").join(gone, ["table_name", "row_key"], "left").withColumn("gone", F.coalesce("gone", none))
    opening = F.filter("opens", lambda x: ~F.array_contains(F.col("gone"), x["line_no"]))
    known = cut(known.withColumn("f", F.try_element_at(opening, F.lit(1))).drop("opens"))
    tails = known.select("table_name", "row_key", "file", "page_no", "gone", F.explode("tails").alias("t")).where(~F.array_contains("gone", F.col("t.line_no")))
    follow = F.try_element_at(F.filter("t.after", lambda x: ~F.array_contains(F.col("gone"), x["line_no"])), F.lit(1))
    tails = tails.select("table_name", "row_key", "file", "page_no", "t.line_no", "t.tail", "t.sign", follow.alias("n"))
    columns = ["table_name", "row_key", "line_no", "tail", "sign"]
    inner = tails.where("n is not null").select(*columns, F.col("n.head").alias("b"), F.col("row_key").alias("next_key"), F.col("n.line_no").alias("next_line"))
    # the first body line of the file's next page: within a bucket of pages, else of the next bucket that has any
    first = known.where("table_name = 'extracted_pages' and f is not null").select("file", "page_no", "row_key", "f").withColumn("bucket", F.floor(F.col("page_no") / bucket_pages))
    within = F.lead(F.struct("row_key", "f.line_no", "f.head")).over(W.partitionBy("file", "bucket").orderBy("page_no", "row_key"))
    opens = first.groupBy("file", "bucket").agg(F.min(F.struct("page_no", "row_key", "f.line_no", "f.head")).alias("o"))
    later = opens.withColumn("l", F.lead("o").over(W.partitionBy("file").orderBy("bucket"))).select("file", "bucket", "l")
    after = first.withColumn("n", within).join(later, ["file", "bucket"], "left").select("row_key", F.coalesce("n.head", "l.head").alias("b"), F.coalesce("n.row_key", "l.row_key").alias("next_key"), F.coalesce("n.line_no", "l.line_no").alias("next_line"))
    over = tails.where("n is null and table_name = 'extracted_pages'").join(after, "row_key").where("next_key is not null").select(*columns, "b", "next_key", "next_line")
    met = inner.union(over).where("b <> ''").withColumn("a", F.regexp_extract("tail", r"([^-]+)$", 1))
    same_case = F.col("b").rlike(r"^[\p{Ll}@!0-9]") | (F.col("b").rlike(r"^\p{Lu}+$") & F.col("a").rlike(r"^\p{Lu}+$"))
    met = met.where(same_case).withColumn("la", F.lower("a")).withColumn("lb", F.lower("b")).withColumn("joined", F.concat("la", "lb")).withColumn("c", F.concat_ws("-", "la", "lb"))
    compound = compounds.select(F.col("word").alias("c"), F.col("n").alias("nc"))
    counts = words.select("word", "n")
    judged = met.join(compound, "c", "left").join(counts.toDF("joined", "nj"), "joined", "left").join(counts.toDF("la", "na"), "la", "left").join(counts.toDF("lb", "nb"), "lb", "left").na.fill(0, ["nc", "nj", "na", "nb"])
    soft = F.col("sign").isin("\u00ad", "\u00ac")
    whole = (F.col("nj") > F.col("nc")) | ((F.col("nj") == 0) & (F.col("nc") == 0) & ~((F.col("na") >= 5) & (F.col("nb") >= 5)))
    return judged.where(soft | whole).select("table_name", "row_key", "line_no", "a", "b", "next_key", "next_line")


class Findings:
    """All stages over the texts of both tables; each is computed once and written."""

    def __init__(self, extracted: DataFrame, rows: DataFrame):
        self.texts = pages(extracted).unionByName(questions(rows))
        every = cut(counted(self.texts))
        words, compounds = every.where("not compound"), every.where("compound")
        laid = cut(layout(self.texts))
        edges = page_lines(laid)
        titles = cut(repeated(edges))
        parts = cut(title_words(titles))
        at, odd = suspected(words, self.texts)
        # one more pass counts the pairs of words that titles and places of suspects ask for
        pairs = cut(pair_counts(self.texts, parts.where("prev is not null").select("prev", "word").union(beside(at))))
        of_file = laid.where("table_name = 'extracted_pages'").groupBy("file").agg(F.count(F.lit(1)).alias("pages"))
        self.furniture = cut(furniture(laid, edges, titles, apart(titles, parts, pairs, words, of_file)))
        self.broken = cut(broken_words(laid, self.furniture, compounds, words))
        self.misread = cut(corrections(at, odd, pairs))

    def found(self) -> DataFrame:
        key = ["table_name", "row_key", "line_no"]
        wrong = self.misread.select(*key).distinct().join(self.furniture.select(*key), key, "left_anti")
        return self.furniture.select(*key, "kind").union(self.broken.select(*key, F.lit("split_word").alias("kind"))).union(wrong.select(*key, F.lit("misread").alias("kind")))

    def repaired(self) -> DataFrame:
        """``table_name``, ``row_key`` and ``clean_text``: without furniture, mended, one line per paragraph.

        A word broken over the end of a page is completed on the first page and taken from the second.
        """
        by = ["table_name", "row_key"]
        drop = self.furniture.groupBy(*by).agg(F.collect_set("line_no").alias("gone"))
        fixes = self.misread.where("w is not null").groupBy(*by).agg(F.collect_list(F.struct("line_no", "w", "v")).alias("fixes"))
        gains = self.broken.groupBy(*by).agg(F.collect_list(F.struct("line_no", "b")).alias("gains"))
        losses = self.broken.select("table_name", F.col("next_key").alias("row_key"), F.struct(F.col("next_line").alias("line_no"), "b").alias("x")).groupBy(*by).agg(F.collect_list("x").alias("losses"))
        # each of these is at most as long as the text has lines and words
        joined = self.texts.select(*by, "text").join(drop, by, "left").join(fixes, by, "left").join(gains, by, "left").join(losses, by, "left")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = Reader()
            as_list = lambda x: [] if x is None else list(x)
            for f in frames:
                out = []
                for r in f.itertuples(index=False):
                    gone = set(as_list(r.gone))
                    wrong: dict[int, dict[str, str]] = {}
                    for x in as_list(r.fixes):
                        wrong.setdefault(x["line_no"], {})[x["w"]] = x["v"]
                    gain = {x["line_no"]: x["b"] for x in as_list(r.gains)}
                    loss = {x["line_no"]: x["b"] for x in as_list(r.losses)}
                    out.append((r.table_name, r.row_key, _reflow(reader, r.text, gone, wrong, gain, loss)))
                yield pd.DataFrame(out, columns=["table_name", "row_key", "clean_text"])

        return joined.mapInPandas(run, "table_name string, row_key long, clean_text string")


def _reflow(reader: Reader, text: str, gone: set[int], wrong: dict[int, dict[str, str]], gain: dict[int, str], loss: dict[int, str]) -> str:
    paragraphs: list[list[str]] = [[]]
    for no, line in enumerate(text.split("\n"), start=1):
        if no in gone:
            continue
        line = reader.plain(line)
        if not line.strip():
            paragraphs.append([])
            continue
        fix = wrong.get(no)
        if fix:

            def mend(m: re.Match, fix: dict[str, str] = fix) -> str:
                got = m[0]
                bare = got.rstrip(".?!:;") or got
                v = fix.get(bare.lower())
                if v is None:
                    return got
                v = v.upper() if len(bare) > 1 and bare.isupper() else v.capitalize() if bare[0].isupper() else v
                return v + got[len(bare) :]

            line = reader.token.sub(mend, line)
        if no in loss and line.lstrip().startswith(loss[no]):
            # what follows the piece without a blank (a full stop, say) goes with it
            rest = line.lstrip()[len(loss[no]) :]
            close = re.match(r"\S*", rest)[0]
            line = rest[len(close) :]
            if paragraphs[-1]:
                paragraphs[-1][-1] += close
        if no in gain:
            line = line.rstrip().rstrip(HYPHEN_SIGNS) + gain[no]
        if line.strip():
            paragraphs[-1].append(" ".join(line.split()))
    # a compound keeps its hyphen where its line ends, and no blank comes in
    return "\n".join(re.sub(r"(?<=\w)- (?=\w)", "-", " ".join(p)) for p in paragraphs if p)
