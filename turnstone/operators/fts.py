"""Full-text search: tokens, postings, query language and BM25.

A query is tried as an expression (AND by default, OR, NOT, phrases with +,
prefixes with *, ^, column filters, NEAR); where it is none it is one exact
phrase, and where that is empty it finds nothing. Double quotes in the query
are doubled first, so they leave empty phrases behind and the words count by
themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import text
from turnstone.session import Scratch

K1, B = 1.2, 0.75
#: Indexed columns and their weights; other columns exist in queries but never match.
WEIGHTS = {"doc_id": 0.0, "content": 1.0}
UNINDEXED = ("session_id", "git_branch", "turn_index", "timestamp", "chunk_type", "project_root")


_TERM = regex.compile(r"[\p{L}\p{N}]+")
_FOLD = str.maketrans(text.ACCENTED, text.PLAIN) | dict.fromkeys(range(0x300, 0x370))


def fold(s: str) -> list[str]:
    """Tokens of a query text, as ``text.tokens`` gives them for a column."""
    return _TERM.findall((s if s.isascii() else s.translate(_FOLD)).lower())


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    first: bool = False
    columns: frozenset[str] | None = None


@dataclass
class Node:
    op: str  # phrase, and, or, not, near
    parts: list = field(default_factory=list)
    phrase: Phrase | None = None
    distance: int = 10


class QuerySyntaxError(ValueError):
    pass


class _Parser:
    """Recursive descent; NOT binds tighter than AND, AND tighter than OR, juxtaposition tightest."""

    def __init__(self, query: str) -> None:
        self.tokens = self._lex(query)
        self.at = 0

    @staticmethod
    def _lex(q: str) -> list[tuple[str, str]]:
        out, i = [], 0
        while i < len(q):
            c = q[i]
            if c in " \t\n\r":
                i += 1
            elif c == '"':
                j, s = i + 1, ""
                while True:
                    if j >= len(q):
                        raise QuerySyntaxError("unterminated string")
                    if q[j] == '"':
                        if j + 1 < len(q) and q[j + 1] == '"':
                            s += '"'
                            j += 2
                            continue
                        break
                    s += q[j]
                    j += 1
                out.append(("string", s))
                i = j + 1
            elif c in "(){}:*^+-,":
                out.append((c, c))
                i += 1
            elif c.isascii() and (c.isalnum() or c in "_\x1a") or not c.isascii():
                j = i
                while j < len(q) and (not q[j].isascii() or q[j].isalnum() or q[j] in "_\x1a"):
                    j += 1
                w = q[i:j]
                out.append((w if w in ("AND", "OR", "NOT") else "string", w))
                i = j
            else:
                raise QuerySyntaxError(f"syntax error near {c!r}")
        return [*out, ("end", "")]

    def peek(self, k: int = 0) -> str:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)][0]

    def take(self, kind: str) -> str:
        if self.peek() != kind:
            raise QuerySyntaxError(f"{kind} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self) -> Node:
        if self.peek() == "end":
            raise QuerySyntaxError("empty")
        node = self._binary("OR")
        self.take("end")
        return node

    def _binary(self, op: str) -> Node:
        lower = {"OR": "AND", "AND": "NOT", "NOT": None}[op]
        node = self._binary(lower) if lower else self._list()
        while self.peek() == op:
            self.at += 1
            right = self._binary(lower) if lower else self._list()
            node = Node(op.lower(), [node, right])
        return node

    def _list(self) -> Node:
        if self.peek() == "(":
            return self._group(None)
        parts = [self._near()]
        while self.peek() in ("string", "^", "{", "-"):
            parts.append(self._near())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def _group(self, columns: frozenset[str] | None) -> Node:
        self.take("(")
        node = self._binary("OR")
        self.take(")")
        return _restrict(node, columns) if columns is not None else node

    def _near(self) -> Node:
        columns = self._columns()
        if columns is not None and self.peek() == "(":
            return self._group(columns)
        if self.peek() == "string" and self.tokens[self.at][1] == "NEAR" and self.peek(1) == "(":
            self.at += 2
            phrases = []
            while self.peek() == "string":
                phrases.append(self._phrase(columns))
            distance = 10
            if self.peek() == ",":
                self.at += 1
                n = self.take("string")
                if not n.isdigit():
                    raise QuerySyntaxError("number expected")
                distance = int(n)
            self.take(")")
            if not phrases:
                raise QuerySyntaxError("NEAR of nothing")
            return Node("near", [Node("phrase", phrase=p) for p in phrases], distance=distance)
        first = self.peek() == "^"
        self.at += first
        p = self._phrase(columns)
        p.first = first
        return Node("phrase", phrase=p)

    def _columns(self) -> frozenset[str] | None:
        known = {*WEIGHTS, *UNINDEXED}
        start, negative = self.at, self.peek() == "-"
        self.at += negative
        names: list[str] = []
        if self.peek() == "{":
            self.at += 1
            while self.peek() == "string":
                names.append(self.take("string"))
            self.take("}")
            self.take(":")
        elif self.peek() == "string" and self.peek(1) == ":":
            names.append(self.take("string"))
            self.take(":")
        elif negative:
            raise QuerySyntaxError("column expected")
        else:
            self.at = start
            return None
        if any(n.lower() not in known for n in names):
            raise QuerySyntaxError("no such column")
        chosen = frozenset(n.lower() for n in names)
        return frozenset(known - chosen) if negative else chosen

    def _phrase(self, columns: frozenset[str] | None) -> Phrase:
        words = fold(self.take("string"))
        prefix = self.peek() == "*"
        self.at += prefix
        while self.peek() == "+":
            self.at += 1
            words += fold(self.take("string"))
            prefix = self.peek() == "*"
            self.at += prefix
        return Phrase(words, prefix, columns=columns)


def _restrict(node: Node, columns: frozenset[str]) -> Node:
    if node.phrase:
        node.phrase.columns = columns if node.phrase.columns is None else node.phrase.columns & columns
    for p in node.parts:
        _restrict(p, columns)
    return node


def parse_query(query: str) -> Node | None:
    """The query as a tree, None if it can find nothing."""
    try:
        return _simplify(_Parser(query.replace('"', '""')).parse())
    except QuerySyntaxError:
        words = fold(query)
        return Node("phrase", phrase=Phrase(words)) if words else None


def _simplify(node: Node) -> Node | None:
    """Without empty phrases, which stand for nothing at all."""
    if node.op == "phrase":
        return node if node.phrase.words else None
    parts = [_simplify(p) for p in node.parts]
    if node.op == "not":
        left, right = parts
        return left if right is None else Node("not", [left, right]) if left else None
    kept = [p for p in parts if p]
    return None if not kept else kept[0] if len(kept) == 1 else Node(node.op, kept, distance=node.distance)


def _starts(tokens: Column, p: Phrase) -> Column:
    """Places at which the phrase stands in a token array, which must be a lambda's variable: another expression would be computed anew for every place."""
    k = len(p.words)

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for j, w in enumerate(p.words):
            t = F.get(tokens, i + j)
            ok = ok & (F.startswith(t, F.lit(w)) if p.prefix and j == k - 1 else t == w)
        return F.coalesce(ok, F.lit(False))

    if p.first:
        return F.filter(F.array(F.lit(0)), here)
    return F.when(F.size(tokens) >= k, F.filter(F.sequence(F.lit(0), F.size(tokens) - k), here)).otherwise(F.array().cast("array<int>"))


def _phrases(node: Node) -> list[Phrase]:
    return [node.phrase] if node.phrase else [p for x in node.parts for p in _phrases(x)]


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """``docs`` with token arrays of the indexed columns and the length D of both."""
    return docs.withColumns({"_id_tokens": text.tokens(F.col(id_col).cast("string")), "_tokens": text.tokens(F.col(text_col))}).withColumn(
        "_dl", F.size("_id_tokens") + F.size("_tokens")
    )


def search(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "content", where: Column | None = None, limit: int | None = 15) -> DataFrame:
    """Rows that match, with ``fts_rank`` (BM25, ascending: better first), at most ``limit`` of them.

    Number of documents, mean length and document frequencies are those of
    ``docs`` as a whole; ``where`` only filters what is returned. Ties go by id.
    The statistics are one row, brought to the scan by a broadcast of that row.
    A query that finds nothing, an empty table and null texts give no rows.
    """
    node = parse_query(query)
    cols = docs.columns
    if node is None:
        return docs.where(F.lit(False)).withColumn("fts_rank", F.lit(0.0))
    phrases = _phrases(node)
    none = F.array().cast("array<int>")

    def facts(own: Column) -> Column:
        """All that is asked of one row's tokens, which are computed once and bound to the lambda's variable."""
        at = [{c: _starts(own[c], p) if p.columns is None or c in p.columns else none for c in WEIGHTS} for p in phrases]
        has = [(F.size(x["doc_id"]) > 0) | (F.size(x["content"]) > 0) for x in at]

        return F.struct(
            (F.size(own["doc_id"]) + F.size(own["content"])).alias("dl"), _matches(node, phrases, at, has).alias("hit"),
            *[F.size(x["content"]).alias(f"f{i}") for i, x in enumerate(at)], *[h.alias(f"h{i}") for i, h in enumerate(has)],
        )

    own = F.struct(text.tokens(F.col(id_col).cast("string")).alias("doc_id"), text.tokens(F.col(text_col)).alias("content"))
    df = docs.withColumn("_x", F.get(F.transform(F.array(own), facts), F.lit(0)))
    df = df.select(*cols, F.col("_x.dl").alias("_dl"), F.col("_x.hit").alias("_hit"), *[F.col(f"_x.f{i}").alias(f"_f{i}") for i in range(len(phrases))], *[F.col(f"_x.h{i}").alias(f"_h{i}") for i in range(len(phrases))])
    stats = df.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(f"_h{i}").alias(f"_n{i}") for i in range(len(phrases))]).withColumn("_one", F.lit(1))
    hits = df.where("_hit")
    if where is not None:
        hits = hits.where(where)
    scored = hits.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")
    out = scored.select(*cols, (-_bm25(len(phrases))).alias("fts_rank"))
    return out.orderBy("fts_rank", id_col).limit(limit) if limit else out


def _bm25(phrases: int) -> Column:
    """Of a row with its length, the counts of the phrases and the statistics of all rows."""
    total = F.lit(0.0)
    for i in range(phrases):
        idf = F.log((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"_f{i}").cast("double")
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return total


def _matches(node: Node, phrases: list[Phrase], at: list[dict[str, Column]], has: list[Column]) -> Column:
    names = {id(p): i for i, p in enumerate(phrases)}

    def of(x: Node) -> Column:
        if x.op == "phrase":
            return has[names[id(x.phrase)]]
        if x.op == "near":
            return _near(x, [at[names[id(p.phrase)]] for p in x.parts])
        parts = [of(p) for p in x.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if x.op == "and" else out | p if x.op == "or" else out & ~p
        return out

    return of(node)


def _within(i: Column, most: int):  # noqa: ANN202
    return lambda j: F.abs(i - j) <= most


def _near(x: Node, at: list[dict[str, Column]]) -> Column:
    """All phrases within ``distance`` tokens of each other in one column."""
    sizes = [len(p.phrase.words) for p in x.parts]
    out = F.lit(False)
    def close(c: str):  # noqa: ANN202
        def ok(i: Column) -> Column:
            parts = [F.exists(places[c], _within(i, x.distance + sum(sizes) - n)) for places, n in zip(at[1:], sizes[1:])]
            return reduce(lambda p, q: p & q, parts, F.lit(True))

        return ok

    for c in WEIGHTS:
        out = out | F.exists(at[0][c], close(c))
    return out


#: What an index holds: a row per term, column and document, sorted by term; and a row of totals per part.
POSTINGS = "term string, col string, doc_id string, tf int, dl int, positions array<int>"
STATS = "n bigint, total bigint"


def _placed(col: str):  # noqa: ANN202
    return lambda t, i: F.struct(F.lit(col).alias("col"), t.alias("term"), i.alias("pos"))


def _moved(by: int):  # noqa: ANN202
    return lambda i: i - by


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(term, col, id, dl, pos): one row per token of the indexed columns, ``dl`` the length of the document."""
    both = [F.transform(text.tokens(F.col(c).cast("string")), _placed(k)) for k, c in (("doc_id", id_col), ("content", text_col))]
    df = docs.select(F.col(id_col).alias("_id"), F.concat(*both).alias("_t")).select("_id", F.size("_t").alias("dl"), F.explode("_t").alias("t"))
    return df.select("t.term", "t.col", F.col("_id").alias(id_col), "dl", "t.pos")


def postings(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Inverted index of both indexed columns: (term, col, id, tf, dl, positions).

    Sorted by term inside range partitions by term and id, so a filter on terms
    reads few pages and a term that is in a third of all texts spans many
    partitions. The partitions also group the rows: one shuffle.
    """
    df = placed.repartitionByRange("term", id_col)
    out = df.groupBy("term", id_col, "col").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return out.select("term", "col", id_col, "tf", "dl", "positions").sortWithinPartitions("term")


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "content") -> None:
    """The index of some documents as tables below ``path``; indexes of parts are read together.

    Tokens are written down first: finding the ranges reads them once more, and
    cutting texts costs more than reading what was cut.
    """
    scratch = Scratch(docs.sparkSession, "index")
    try:
        placed = scratch.save(places(docs, id_col, text_col), "places")
        postings(placed, id_col).write.mode("overwrite").parquet(f"{path}/postings")
        total = docs.agg(F.count("*").alias("n")).crossJoin(placed.agg(F.count("*").alias("total")))  # one row each
        total.write.mode("overwrite").parquet(f"{path}/stats")
    finally:
        scratch.drop()


def read_index(spark: SparkSession, paths: list[str], id_type: str = "string") -> tuple[DataFrame, DataFrame]:
    """(postings, totals) of indexes written before."""
    post = POSTINGS.replace("doc_id string", f"doc_id {id_type}")
    if not paths:
        return spark.createDataFrame([], post), spark.createDataFrame([], STATS)
    return spark.read.schema(post).parquet(*[f"{p}/postings" for p in paths]), spark.read.schema(STATS).parquet(*[f"{p}/stats" for p in paths])


def search_index(post: DataFrame, stats: DataFrame, query: str, id_col: str = "doc_id", allowed: DataFrame | None = None, limit: int | None = 15) -> DataFrame:
    """(id, fts_rank) of the documents that match, as ``search`` ranks them, from a stored index.

    The scan gets a filter on the query's terms and prefixes; what is shuffled
    are the places of these terms. ``allowed`` (ids) only filters what is
    returned. The counts of phrases come from the same grouped rows.
    """
    node = parse_query(query)
    if node is None:
        return post.where(F.lit(False)).select(id_col, F.lit(0.0).alias("fts_rank"))
    phrases = _phrases(node)
    words = sorted({(w, p.prefix and j == len(p.words) - 1) for p in phrases for j, w in enumerate(p.words)})
    number = {w: k for k, w in enumerate(words)}

    def is_word(w: tuple[str, bool]) -> Column:
        return F.startswith("term", F.lit(w[0])) if w[1] else F.col("term") == w[0]

    exact, prefixes = [w for w, open_end in words if not open_end], [w for w, open_end in words if open_end]
    wanted = reduce(lambda a, b: a | b, [F.col("term").startswith(w) for w in prefixes] + ([F.col("term").isin(exact)] if exact else []))
    none = F.array().cast("array<int>")
    places = [
        F.flatten(F.collect_list(F.when(is_word(w) & (F.col("col") == c), F.col("positions")))).alias(f"p{number[w]}_{c}") for w in words for c in WEIGHTS
    ]
    df = post.where(wanted).groupBy(id_col).agg(F.first("dl").alias("_dl"), *places)

    def starts(p: Phrase, c: str) -> Column:
        if p.columns is not None and c not in p.columns:
            return none
        own = [F.col(f"p{number[w, p.prefix and j == len(p.words) - 1]}_{c}") for j, w in enumerate(p.words)]
        out = own[0]
        for j, x in enumerate(own[1:], 1):
            out = F.array_intersect(out, F.transform(x, _moved(j)))
        return F.filter(out, lambda i: i == 0) if p.first else out

    df = df.withColumns({f"s{i}_{c}": starts(p, c) for i, p in enumerate(phrases) for c in WEIGHTS})
    at = [{c: F.col(f"s{i}_{c}") for c in WEIGHTS} for i in range(len(phrases))]
    has = [(F.size(x["doc_id"]) > 0) | (F.size(x["content"]) > 0) for x in at]
    matches = _matches(node, phrases, at, has)
    df = df.select(id_col, "_dl", matches.alias("_hit"), *[F.size(x["content"]).alias(f"_f{i}") for i, x in enumerate(at)], *[h.alias(f"_h{i}") for i, h in enumerate(has)])
    seen = df.agg(*[F.count_if(f"_h{i}").alias(f"_n{i}") for i in range(len(phrases))]).withColumn("_one", F.lit(1))
    whole = stats.agg(F.sum("n").alias("_n"), (F.sum("total") / F.sum("n")).alias("_avg")).withColumn("_one", F.lit(1))
    hits = df.where("_hit")
    if allowed is not None:
        hits = hits.join(allowed.select(id_col), id_col, "left_semi")
    scored = hits.withColumn("_one", F.lit(1)).join(F.broadcast(seen), "_one").join(F.broadcast(whole), "_one")  # one row each
    out = scored.select(id_col, (-_bm25(len(phrases))).alias("fts_rank"))
    return out.orderBy("fts_rank", id_col).limit(limit) if limit else out
