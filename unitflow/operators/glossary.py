"""Terms and their use in units: a query set of terms against all units.

Terms go to the executors in blocks of bounded size. A block's terms form one automaton, with which a task reads each text once, whatever
the number of terms; the terms a text holds are numbers, and only these meet the table of terms.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitflow.functions import scripts
from unitflow.functions.written import written

# Kinds of terms, and other names for them.
KINDS = ("男性角色", "女性角色", "未知性别角色", "地名", "家族", "组织", "特殊物品", "特殊技能", "特殊生物", "特殊概念", "其他")
NAMED = {
    "": "其他", "other": "其他", "others": "其他", "男": "男性角色", "男性": "男性角色", "male": "男性角色", "女": "女性角色", "女性": "女性角色", "female": "女性角色", "place": "地名", "location": "地名",
    "org": "组织", "organization": "组织", "family": "家族", "clan": "家族", "item": "特殊物品", "skill": "特殊技能", "creature": "特殊生物", "monster": "特殊生物",
}
JSON_TERMS = "array<struct<src:string,dst:string,info:string,case_sensitive:boolean>>"
#: Bytes of the terms of a block.
BLOCK_BYTES = 8 << 20


def term_hits(term: Column, text: Column, case_sensitive: Column) -> Column:
    """Whether a text holds a term: as it is, or in lower case where case doesn't matter; an empty term never hits."""
    return (term != "") & (F.contains(text, term) | (~case_sensitive & F.contains(F.lower(text), F.lower(term))))


_LAST: dict[str, list] = {}


def _automata(name: str, sent) -> list:
    """A block's automata, built once in a worker process. For each list of terms: one of the terms as they are, and one of those whose case doesn't
    matter, in lower case; each word leads to the numbers of its terms."""
    if name not in _LAST:
        _LAST.clear()
        built = []
        for terms in sent.value:
            words: tuple[dict, dict] = ({}, {})
            for k, (term, sensitive) in enumerate(terms):
                for own, word in ((words[0], term), (words[1], None if sensitive or not term else term.lower())):
                    if word:
                        own.setdefault(word, []).append(k)
            pair = []
            for own in words:
                automaton = ahocorasick.Automaton()
                for word, ks in own.items():
                    automaton.add_word(word, ks)
                automaton.make_automaton()
                pair.append(automaton)
            built.append(pair)
        _LAST[name] = built
    return _LAST[name]


def _found(text: str | None, exact, lower) -> list[int]:
    hits: set[int] = set()
    for automaton, own in ((exact, text), (lower, text.lower() if text and len(lower) else text)):
        if own and len(automaton):
            for _, ks in automaton.iter(own):
                hits.update(ks)
    return sorted(hits)


def _blocks(terms: DataFrame, columns: list[str], case_sensitive: Column | None) -> Iterator[tuple]:
    """(name, broadcast of (term, case_sensitive) for each of the columns, the block's terms with their numbers as __k) of each block of the query set."""
    spark = terms.sparkSession
    flag = F.lit(True) if case_sensitive is None else F.coalesce(case_sensitive, F.lit(False))
    own = terms.where(F.col(columns[0]) != "").withColumn("__exact", flag)
    n = -(-(own.agg(F.sum(F.octet_length(F.concat_ws("", *columns)))).first()[0] or 0) // BLOCK_BYTES) or 1
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in terms.schema.fields)
    for block in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64(columns[0]), F.lit(n)) == block)
        rows = list(part.toLocalIterator())  # one block of the query set
        numbered = spark.createDataFrame([(k, *(r[c] for c in terms.columns)) for k, r in enumerate(rows)], f"__k int, {fields}")
        yield uuid.uuid4().hex, spark.sparkContext.broadcast([[(r[c], r["__exact"]) for r in rows] for c in columns]), numbered


def _marked(units: DataFrame, name: str, sent, text_cols: list[str]) -> DataFrame:
    """The units with the numbers of the terms in each text, in arrays __k0, __k1 ..., in the texts' place."""
    keep = [c for c in units.columns if c not in text_cols]
    types = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    places, texts = [units.columns.index(c) for c in keep], [units.columns.index(c) for c in text_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(name, sent)
        for batch in batches:
            found = [pa.array([_found(t, *automata[k]) for t in batch.column(i).to_pylist()], pa.list_(pa.int32())) for k, i in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *found], names=[*keep, *(f"__k{k}" for k in range(len(texts)))])

    return units.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"__k{k} array<int>" for k in range(len(texts)))]))


def occurrences(units: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "src", case_sensitive: Column | None = None) -> DataFrame:
    """A row for each unit and each term that its text holds: the columns of the unit but for the text, and those of the term. One narrow pass
    over the texts for each block of terms; a block's terms, which are bounded, are sent to meet the numbers found."""
    def meet(name, sent, own) -> DataFrame:
        hits = _marked(units, name, sent, [text_col]).withColumn("__k", F.explode("__k0")).drop("__k0")
        return hits.join(F.broadcast(own), "__k").drop("__k")

    return _each(_blocks(terms, [term_col], case_sensitive), meet)


def applied(units: DataFrame, terms: DataFrame, source_col: str, done_col: str, term_col: str = "src", wanted_col: str = "dst") -> DataFrame:
    """A row for each unit and each term in its source, with applied: whether the translation holds the term's. Both texts are read in one
    pass, and neither leaves it."""

    def meet(name, sent, own) -> DataFrame:
        hits = _marked(units, name, sent, [source_col, done_col]).withColumn("__k", F.explode("__k0"))
        hits = hits.withColumn("applied", F.array_contains("__k1", F.col("__k"))).drop("__k0", "__k1")
        return hits.join(F.broadcast(own), "__k").drop("__k")

    return _each(_blocks(terms, [term_col, wanted_col], None), meet)


def _each(blocks: Iterator[tuple], meet) -> DataFrame:
    """What all blocks of terms find. Of more blocks than one, each one's hits are written before the next is fetched, and its terms are given up."""
    first, *more = itertools.islice(blocks, 2)
    if not more:
        return meet(*first)
    parts = []
    for name, sent, own in itertools.chain([first], more, blocks):
        parts.append(written(meet(name, sent, own), "terms-found"))
        sent.destroy()
    return reduce(DataFrame.unionByName, parts)


def vote_winner(votes: DataFrame, key: str, value: str) -> DataFrame:
    """The value of most votes for each key; of equal ones the least string."""
    n = votes.groupBy(key, value).agg(F.count("*").alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("n"), F.col(value).alias("v")))
    return n.groupBy(key).agg(best.alias("b"), F.sum("votes").alias("n_cast")).select(key, F.col("b.v").alias(value), (-F.col("b.n")).alias("votes"), "n_cast")


def select_for(batches: DataFrame, terms: DataFrame, batch: list[str], limit: int) -> DataFrame:
    """The terms each batch's text holds, the most frequent first, up to a limit for each batch."""
    hits = occurrences(batches, terms)
    rank = F.row_number().over(Window.partitionBy(*batch).orderBy(F.desc("count"), "src"))
    return hits.select(*batch, "src", "count", rank.cast("long").alias("rank")).where(F.col("rank") <= limit)


def kind_of(info: Column) -> Column:
    """The kind that a label stands for, null for one that is unknown."""
    label = scripts.trim(F.coalesce(info, F.lit("")))
    return F.when(label.isin(*KINDS), label).otherwise(F.try_element_at(F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair)), F.lower(label)))


def accepted(extracted: DataFrame, units: DataFrame, text_col: str = "text") -> DataFrame:
    """The terms a model named that may stand: of two characters or more, translated, no literal, of a known kind, and found in some text as they are.
    extracted: src, dst and info."""
    own = extracted.select(*(scripts.trim(F.col(c)).alias(c) for c in ("src", "dst")), kind_of(F.col("info")).alias("info"))
    own = own.where((F.char_length("src") >= 2) & (F.col("dst") != "") & ~scripts.machine_literal(F.col("src")) & F.col("info").isNotNull())
    found = occurrences(units.select(text_col), own.select("src").distinct(), text_col).select("src").distinct()
    return own.join(found, "src", "left_semi")


def violations(found: DataFrame) -> DataFrame:
    """src, dst, occurrences, applied and missed of the terms that some translation lacks, the most missed first. found: rows of applied()."""
    n = found.groupBy("src", "dst").agg(F.count("*").alias("occurrences"), F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("missed"))
    return n.where("missed > 0").orderBy(F.desc("missed"), "src")


def from_json_file(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Terms of glossary files in JSON: a list of records, or an object of sources and translations. Of a source that is named twice the last counts;
    what is neither shape has none."""
    text = F.col(text_col)
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, JSON_TERMS))
    pairs = F.when(F.ltrim(text).startswith("{"), F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("src"), e["value"].alias("dst"), F.lit("").alias("info"), F.lit(False).alias("case_sensitive"))))
    rows = files.select(F.posexplode(F.coalesce(listed, pairs)).alias("k", "t")).select("k", "t.*").where("src <> ''")
    last = rows.groupBy("src").agg(F.max_by(F.struct(F.coalesce("dst", F.lit("")).alias("dst"), F.coalesce("info", F.lit("")).alias("info"), F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive")), "k").alias("t"))
    return last.select("src", "t.*")


def to_json_file(terms: DataFrame) -> DataFrame:
    """One row, text: the glossary as a JSON list, in order of the sources."""
    return terms.agg(F.to_json(F.sort_array(F.collect_list(F.struct("src", "dst", "info", "case_sensitive")))).alias("text"))
