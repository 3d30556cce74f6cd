"""Generated, minified and vendored source files and data saved as code, told apart by Re-Pair grammars of their tokens.

Every file gets two grammars. That of its code (without comments and line breaks), inferred in the file itself and
carried on by hashes to a single symbol, has rules that are equal wherever the tokens are equal: long rules used in two
repositories show a copy of an outside library, as far as they reach. That of its whole text (path, comments, line
breaks, code), inferred over many files together, holds what files have in common: rules that the corpus uses mostly in
files which declare that a tool wrote them are typical of tools and flag every file that uses them, declared or not,
while a declaration alone flags nothing; and code whose rules hold no line breaks is minified. A third grammar, of the
literals only, finds blobs: literals that no rule absorbs. Nothing but these grammars gives a verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import repair

#: Tokens of a rule that is long enough to count as copied.
LONG_RULE = 24
#: Share of a file's tokens in rules shared by two repositories that makes it a copy, and tokens the longest of them must have:
#: short ones are shared by chance where there are many files.
COPIED, COPIED_RULE = 0.5, 48
#: Tokens of a rule that may be typical of a tool.
TYPICAL_RULE = 4
#: A rule is typical if, by the lower bound (95 %), the odds that a file with it is declared are so many times those of any file.
TYPICAL = 3.0
#: Weight of typical rules among a file's rules that makes it generated.
GENERATED = 0.25
#: Lower bound (95 %) of the share of declared files among those with a rule, from which the rule alone makes a file generated.
STRONG = 0.6
#: Share of characters in literals other than words, and of literals no rule absorbs, that makes a file data.
LITERAL, INCOMPRESSIBLE = 0.4, 0.5
#: Share of tokens in rules with a line break below which a file is minified, and the tokens it must have to tell.
LAID, MINIFIED_TOKENS = 0.1, 100
#: Rows of a broadcast table of rules at most; beyond, it is joined.
BROADCAST_RULES = 100_000
#: Files per grammar batch and tokens in them at least, unless a task has fewer; at most twice as many and one file more.
BATCH_FILES, BATCH_TOKENS = 500, 250_000

_PARTS = re.compile(r"""(//[^\n]*|/\*.*?\*/|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""", re.S)
_TOKEN = re.compile(r"\w+|[^\w\s]")
_LINES = re.compile(r"\n\s*|\w+|[^\w\s]")

# What tools write about files they wrote, in comments before the first or after the last line of code.
_BANNER = re.compile(
    r"<auto-?generated|@generated\b|\b(?:auto|machine|automatically)[- ]?generated\b"
    r"|\b(?:generated|produced|emitted|created|erzeugt|generiert|généré|generado|generato|gerado)\s+(?:automatically\s+)?(?:by|with|from|using|mit|von|aus|par|por|da)\b"
    r"|\bdo(?: not|n't) (?:edit|modify|change)(?: (?:this file|by hand|manually))?\s*(?:[.!;*/-]|$)|\b(?:changes|edits)(?: \w+){0,6} lost\b"
    r"|\b(?:start|begin|beginning|end) of (?:the )?(?:generated |tool )?output\b",
    re.I | re.M,
)
# What people write about files that a tool wrote once or that speak of tools.
_BY_HAND = re.compile(r"\b(?:maintained|written|edited|kept|changed) by (?:hand|us)\b|\bedit freely\b|\bhand-?written\b|\bgenerated (?:\w+ )?(?:once|originally)\b", re.I)
_ATTRIBUTE = re.compile(r"\[\s*(?:assembly:\s*)?(?:[\w.]+\.)?(?:GeneratedCode|CompilerGenerated)(?:Attribute)?\s*[(\]]|^\s*#\s*(?:pragma checksum|line hidden)", re.M)
_TOOL_PATH = re.compile(r"\.g(?:\.i)?\.cs$|\.generated\.\w+$|\.designer\.cs$|(?:^|/)obj/", re.I)

_SCHEMA = (
    "row bigint, file string, repo_id bigint, tokens int, literal double, open_literals double, laid double, declared boolean, "
    "part array<bigint>, part_n array<int>, part_up array<bigint>, rule array<bigint>, rule_w array<int>"
)


def _wordlike(token: str) -> bool:
    """Whether a token in a literal is a word or a name, not data."""
    stem = token.rstrip("0123456789_").replace("_", "")
    return 3 <= len(stem) <= 24 and stem.isalpha()


class _Hashes(dict):
    """Words and their stable hashes."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class _Reader:
    """Tokens of one file, as stable hashes."""

    def __init__(self) -> None:
        self.known = _Hashes()

    def hashes(self, words: list[str]) -> list[int]:
        if len(self.known) > 500_000:
            self.known.clear()
        return list(map(self.known.__getitem__, words))

    def read(self, key: int, file: str | None, text: str) -> tuple[list[int], list[int], list[int], float, bool]:
        """(hashes of the code's tokens, of its literals, of the whole text's tokens; share of data; whether the file declares a tool)."""
        text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
        code: list[str] = []
        literals: list[str] = []
        # the same word is another token in a path, in a comment, in a string and in code; numbers are one token
        whole = ["p" + w for w in _TOKEN.findall(file or "")]
        names = len(whole)
        notes: list[tuple[int, str]] = []
        last_code = -1
        literal_chars = 0
        parts = _PARTS.split(text)
        for k, part in enumerate(parts):
            if k % 2 == 0:
                lines = ["\n" if w[0] == "\n" else w for w in _LINES.findall(part)]
                words = [w for w in lines if w != "\n"]
                if not words:
                    whole += lines
                    continue
                last_code = k
                code += words
                numbers = [w for w in words if "0" <= w[0] <= "9"]
                literals += numbers
                literal_chars += sum(map(len, numbers))
                whole += ["0" if "0" <= w[0] <= "9" else w for w in lines] if numbers else lines
            elif part.startswith(("//", "/*")):
                notes.append((k, part))
                whole += ["c0" if w[0].isdigit() else "c" + w for w in _TOKEN.findall(part)]
            else:
                last_code = k
                words = _TOKEN.findall(part)
                code += words
                literals += [w for w in words if w[0].isalnum()]
                literal_chars += sum(len(w) for w in words if not _wordlike(w))
                whole += ["s0" if w[0].isdigit() else "s" + w for w in words]
        first_code = next((k for k, p in enumerate(parts) if (k % 2 == 0 and p.strip()) or (k % 2 and not p.startswith(("//", "/*")))), len(parts))
        outer = [p for k, p in notes if k < first_code or k > last_code]
        banner = any(map(_BANNER.search, outer)) and not any(map(_BY_HAND.search, outer))
        declared = bool(code) and (banner or bool(_ATTRIBUTE.search("".join(parts[::2]))) or bool(_TOOL_PATH.search(file or "")))
        known = self.hashes(whole)
        # a token of its own ends the path: no rule goes from there into the text
        known.insert(names, xxhash.xxh64_intdigest(f"{key} {file}"))
        return self.hashes(code), self.hashes(literals), known, literal_chars / max(1, sum(map(len, code))), declared


_BREAK = xxhash.xxh64_intdigest("\n")


def first_folder(file: Column) -> Column:
    """The repository of a path where nothing else is known: its first folder, below ``src`` the second."""
    return F.regexp_extract(F.coalesce(file, F.lit("")), r"^(?:src/)?[^/]+", 0)


def _lists(owner: np.ndarray, n: int, *columns: tuple[np.ndarray, pa.DataType]) -> list[pa.ListArray]:
    order = np.argsort(owner, kind="stable")
    bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32), pa.int32())
    return [pa.ListArray.from_arrays(bounds, pa.array(values[order], kind)) for values, kind in columns]


def _grammar(sequences: list[list[int]], **how) -> repair.Grammars:
    sizes = np.array([len(s) for s in sequences], np.int64)
    return repair.infer(np.array([h for s in sequences for h in s], np.uint64), np.repeat(np.arange(len(sequences)), sizes), len(sequences), **how)


def features(sources: DataFrame, file: str = "file", text: str = "text", repository: str | None = None) -> DataFrame:
    """One row per row with text: its rules as hashes of the tokens they stand for, and shares of its tokens.

    ``part``: the long rules of the code with their tokens and the rule they went into (0: none); ``rule``: the distinct
    rules of the whole text that other places of the batch use too, weighted by the tokens they cover in the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            keys, names, repos, codes, lits, wholes, literal, declared = map(list, zip(*rows))
            n = len(rows)
            g = _grammar(codes, finish=True)
            long = g.size >= LONG_RULE
            up = np.where(g.above >= 0, g.hash[g.above], np.uint64(0))[long] if len(g.hash) else g.hash
            parts = _lists(g.of[long], n, (g.hash[long].view(np.int64), pa.int64()), (g.size[long].astype(np.int32), pa.int32()), (up.view(np.int64), pa.int64()))
            lg = _grammar(lits)
            w = _grammar(wholes, together=True, mark=_BREAK)
            good = w.size >= TYPICAL_RULE
            key, at, times = np.unique(repair.scrambled(w.hash[good] ^ repair.scrambled(w.of[good].astype(np.uint64))), return_index=True, return_counts=True)
            of, hash_, weight = w.of[good][at], w.hash[good][at], (w.size[good][at] * times).astype(np.int32)
            rules = _lists(of, n, (hash_.view(np.int64), pa.int64()), (weight, pa.int32()))
            open_literals = np.where(lg.tokens > 0, 1 - lg.covered / np.maximum(lg.tokens, 1), 0.0)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array([xxhash.xxh64_intdigest(r or "") >> 1 for r in repos], pa.int64()), pa.array(g.tokens.astype(np.int32)),
                    pa.array(literal, pa.float64()), pa.array(open_literals), pa.array(w.marked / np.maximum(w.tokens, 1)), pa.array(declared, pa.bool_()), *parts, *rules,
                ],
                names=[c.split()[0] for c in _SCHEMA.split(", ")],
            )

        # the last batch of a task joins the one before: a grammar of few files has few rules
        held: list[tuple] = []
        rows: list[tuple] = []
        size = 0
        with np.errstate(over="ignore"):
            for b in batches:
                for key, name, repo, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                    code, literals, whole, data, declared = reader.read(key, name, t)
                    rows.append((key, name, repo, code, literals, whole, data, declared))
                    size += len(whole)
                    if len(rows) >= BATCH_FILES or size >= BATCH_TOKENS:
                        if held:
                            yield flush(held)
                        held, rows, size = rows, [], 0
            if held or rows:
                yield flush(held + rows)

    repo = F.col(repository) if repository else first_folder(F.col(file))
    picked = sources.select(F.monotonically_increasing_id().alias("row"), F.col(file).alias("file"), repo.cast("string").alias("repo"), F.col(text).alias("text"))
    return picked.where(F.length("text") > 0).mapInArrow(run, _SCHEMA)


def _small(table: DataFrame) -> DataFrame:
    """``table`` stored, as a broadcast where it has few enough rows."""
    table = stored(table, "rules")
    return F.broadcast(table) if table.count() <= BROADCAST_RULES else table


def _bound(hits: Column, n: Column) -> Column:
    """Lower bound (95 %) of a share after Wilson."""
    z = 1.96
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def judged(sources: DataFrame, file: str = "file", text: str = "text", repository: str | None = None) -> DataFrame:
    """(file, generated, minified, vendored, data, ...): a verdict on each row with text, and the measures it rests on.

    ``shared``: share of the code's tokens in long rules that another repository uses too, ``longest``: tokens of the longest;
    ``typical``: weight of typical
    rules among the rules of the whole text, ``strong``: the highest lower bound of declared files among those with one of
    the file's rules; ``laid``: share of tokens in rules with a line break; ``literal``, ``open_literals``: share of
    characters that are data, and of literals no rule absorbs. ``declared`` only trains and is no verdict: the banner of a
    single file is no rule. Null and empty texts have no row; a text of blanks and comments only is hand-written. Rows with
    a null or a repeated name are judged one by one. ``repository``: a column; else the first folder of the path, below
    ``src`` the second. What a file's rules tell depends on the other files, so its verdict may change with the table.
    """
    facts = stored(features(sources, file, text, repository), "features")
    parts = facts.select("row", "repo_id", F.explode(F.arrays_zip("part", "part_n", "part_up")).alias("p")).select("row", "repo_id", F.col("p.part").alias("h"), F.col("p.part_n").alias("n"), F.col("p.part_up").alias("up"))
    spread = _small(parts.groupBy("h").agg(F.min("repo_id").alias("a"), F.max("repo_id").alias("b")).where("a <> b").select("h"))
    # of nested rules the outermost counts: one that went into no shared rule
    outermost = parts.join(spread, "h", "left_semi").join(spread.select(F.col("h").alias("up")), "up", "left_anti")
    shared = outermost.groupBy("row").agg(F.sum("n").alias("shared_n"), F.max("n").alias("longest"))

    rules = facts.select("row", "declared", F.explode(F.arrays_zip("rule", "rule_w")).alias("r")).select("row", "declared", F.col("r.rule").alias("h"), F.col("r.rule_w").alias("w"))
    seen = rules.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.col("declared").cast("long")).alias("hits"))
    known = facts.agg(F.avg(F.col("declared").cast("double"))).first()[0] or 0.0
    odds = TYPICAL * known / (1 - known) if known < 1 else float("inf")
    low = _bound(F.col("hits"), F.col("n"))
    marks = _small(seen.where(F.col("hits") >= 2).withColumn("low", low).where((F.col("low") >= F.lit(odds) * (1 - F.col("low"))) | (F.col("low") >= STRONG)).select("h", "low"))
    typical = rules.join(marks, "h").groupBy("row").agg(F.sum("w").alias("typical_w"), F.max("low").alias("strong"))

    weight = F.aggregate("rule_w", F.lit(0).cast("long"), lambda a, x: a + x)
    part = lambda c, whole: F.coalesce(F.col(c), F.lit(0)) / F.greatest(whole, F.lit(1))
    rows = facts.drop("part", "part_n", "part_up", "rule").join(shared, "row", "left").join(typical, "row", "left")
    rows = rows.withColumn("shared", part("shared_n", F.col("tokens"))).withColumn("typical", part("typical_w", weight)).withColumn("strong", F.coalesce("strong", F.lit(0.0)))
    data = (F.col("literal") >= LITERAL) & (F.col("open_literals") >= INCOMPRESSIBLE)
    return rows.select(
        "file",
        ((F.col("strong") >= STRONG) | (F.col("typical") >= GENERATED)).alias("generated"),
        (~data & (F.col("laid") < LAID) & (F.col("tokens") >= MINIFIED_TOKENS)).alias("minified"),
        ((F.col("shared") >= COPIED) & (F.coalesce("longest", F.lit(0)) >= COPIED_RULE)).alias("vendored"),
        data.alias("data"),
        "shared", "longest", "typical", "strong", "laid", "tokens", "literal", "open_literals", "declared",
    )


def not_by_hand(verdicts: DataFrame) -> DataFrame:
    """The files of ``judged`` that no hand wrote."""
    return verdicts.where(F.col("generated") | F.col("minified") | F.col("vendored") | F.col("data"))
