"""The search language: terms, phrases, field:term, prefix*, AND, OR, NOT and parentheses, parsed into a tree on the driver
and evaluated as one DataFrame of document ids."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_LENGTH, MIN_LENGTH, STOP_WORDS
from ..operators.index import Index

_STOP = frozenset(STOP_WORDS)
_LEX = re.compile(r'\s*(?:(\()|(\))|"([^"]*)(?:"|$)|([A-Za-z_]\w*):(?=\S)|([^\s()"]+))')
FIELDS = ("title", "body", "source", "url", "site")


def split_terms(text: str) -> list[str]:
    """What the index would hold of a text."""
    return [t for t in re.findall(r"[^\W_]+", text.lower()) if MIN_LENGTH <= len(t) <= MAX_LENGTH and re.search("[a-z]", t) and t not in _STOP]


@dataclass(frozen=True)
class Term:
    term: str
    field: str | None = None


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    field: str | None = None


@dataclass(frozen=True)
class Prefix:
    prefix: str
    field: str | None = None


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


def tokens(query: str) -> list[tuple[str, str]]:
    """(kind, value): "(", ")", phrase, field, op, word. An unclosed quote reaches to the end."""
    out: list[tuple[str, str]] = []
    at = 0
    while (m := _LEX.match(query, at)) and m.end() > at:
        at = m.end()
        if m[1] or m[2]:
            out.append((m[1] or m[2], ""))
        elif m[3] is not None:
            out.append(("phrase", m[3]))
        elif m[4] and m[4].lower() in FIELDS:
            out.append(("field", m[4].lower()))
        else:
            word = m[5] if m[5] is not None else m[4]
            out.append(("op", word.upper()) if word.upper() in ("AND", "OR", "NOT") else ("word", word))
    return out


def parse(query: str):
    """The tree, or None if nothing in the query is indexed. OR binds loosest, then AND (written or not), then NOT."""
    toks, at = tokens(query), 0

    def peek() -> tuple[str, str]:
        return toks[at] if at < len(toks) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return toks[at - 1]

    def any_of():
        parts = [all_of()]
        while peek() == ("op", "OR"):
            take()
            parts.append(all_of())
        return _join(Or, parts)

    def all_of():
        parts = []
        while peek()[0] not in ("end", ")") and peek() != ("op", "OR"):
            if peek() == ("op", "AND"):
                take()
                continue
            parts.append(negated())
        return _join(And, parts)

    def negated():
        if peek() == ("op", "NOT"):
            take()
            inner = negated() if peek()[0] not in ("end", ")") else None
            return None if inner is None else inner.of if isinstance(inner, Not) else Not(inner)
        return single(None)

    def single(field):
        kind, value = take() if at < len(toks) else ("end", "")
        if kind == "(":
            inner = any_of()
            if peek()[0] == ")":
                take()
            return inner
        if kind == "field":
            return single(value)
        if kind == "phrase":
            got = tuple(split_terms(value))
            return (Term(got[0], field) if len(got) == 1 else Phrase(got, field)) if got else None
        if kind == "word":
            if value.endswith("*") and len(value) > 1:
                return Prefix(value[:-1].lower(), field)
            if field in ("source", "url", "site"):
                return Term(value.lower(), field)
            return _join(And, [Term(t, field) for t in split_terms(value)])
        return None

    return any_of()


def _join(kind, parts):
    flat = [x for p in parts if p is not None for x in (p.parts if isinstance(p, kind) else (p,))]
    return None if not flat else flat[0] if len(flat) == 1 else kind(tuple(flat))


def positive_terms(node) -> list[str]:
    """Terms to rank by: those that aren't negated, in order, each once."""
    match node:
        case Term(term, field):
            return [] if field in ("source", "url", "site") else [term]
        case Phrase(terms, _):
            return list(dict.fromkeys(terms))
        case And(parts) | Or(parts):
            return list(dict.fromkeys(t for p in parts for t in positive_terms(p)))
    return []


def evaluate(node, ix: Index) -> DataFrame:
    """doc_id of each match, once. A term reads its own postings; AND is a chain of semi joins, AND NOT an anti join; only a
    NOT that stands alone reads all documents."""
    ids = lambda df: df.select("doc_id").distinct()
    match node:
        case None:
            return ids(ix.docs).limit(0)
        case Term(term, field) if field in ("source", "url", "site"):
            return ids(ix.docs.where(F.lower("source") == term))
        case Term(term, field):
            return ids(_field(ix.posts(term), field))
        case Prefix(prefix, field) if field in ("source", "url", "site"):
            return ids(ix.docs.where(F.lower("source").startswith(prefix)))
        case Prefix(prefix, field):
            return ids(_field(ix.postings.where(F.col("term").startswith(prefix)), field))
        case Phrase(terms, field):
            return ids(phrase(ix, terms, field))
        case Or(parts):
            return ids(reduce(DataFrame.unionByName, [evaluate(p, ix) for p in parts]))
        case Not(of):
            return ids(ix.docs).join(evaluate(of, ix), "doc_id", "left_anti")
        case And(parts):
            yes = [p for p in parts if not isinstance(p, Not)]
            got = evaluate(yes[0], ix) if yes else ids(ix.docs)
            for p in yes[1:]:
                got = got.join(evaluate(p, ix), "doc_id", "left_semi")
            for p in parts:
                if isinstance(p, Not):
                    got = got.join(evaluate(p.of, ix), "doc_id", "left_anti")
            return got
    raise TypeError(f"no such node: {node!r}")


def _field(posts: DataFrame, field: str | None) -> DataFrame:
    return posts if field is None else posts.where(F.col("field") == field)


def phrase(ix: Index, terms: tuple[str, ...], field: str | None = None) -> DataFrame:
    """doc_id, field of texts that hold the terms at adjacent positions: positions are shifted to the phrase's start, and a
    start that every term has is a match."""
    mine = reduce(DataFrame.unionByName, [ix.posts(t) for t in sorted(set(terms))])
    places = F.create_map(*[x for t in sorted(set(terms)) for x in (F.lit(t), F.array(*[F.lit(i) for i, u in enumerate(terms) if u == t]))])
    rows = _field(mine, field).select("doc_id", "field", places[F.col("term")].alias("at"), F.explode("positions").alias("pos"))
    starts = rows.select("doc_id", "field", "pos", F.explode("at").alias("i")).select(
        "doc_id", "field", "i", (F.col("pos") - F.col("i")).alias("start")
    )
    return starts.groupBy("doc_id", "field", "start").agg(F.countDistinct("i").alias("n")).where(F.col("n") == len(terms)).select("doc_id", "field").distinct()


def left_fold(query: str, ix: Index) -> DataFrame:
    """The simple language: words and AND, OR, NOT, no precedence but OR between groups, folded from the left."""
    groups: list[list[str]] = [[]]
    for w in query.split():
        groups.append([]) if w.upper() == "OR" else groups[-1].append(w)
    ids = lambda t: ix.posts(t).select("doc_id").distinct()

    def one(ws: list[str]) -> DataFrame | None:
        got, no = None, False
        for w in ws:
            if w.upper() in ("AND", "NOT"):
                no = w.upper() == "NOT"
                continue
            for t in split_terms(w):
                if got is None:
                    got = ix.docs.select("doc_id").join(ids(t), "doc_id", "left_anti") if no else ids(t)
                else:
                    got = got.join(ids(t), "doc_id", "left_anti" if no else "left_semi")
            no = False
        return got

    parts = [p for g in groups if (p := one(g)) is not None]
    return reduce(DataFrame.unionByName, parts).distinct() if parts else ix.docs.select("doc_id").limit(0)
