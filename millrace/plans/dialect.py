"""What a SQL stage may write that Spark spells otherwise."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QueryError
from .lex import Token, text_of, tokens

FUNCTIONS = {
    "REGEXP_MATCHES": "regexp_like", "STRING_SPLIT_REGEX": "split", "STRFTIME": "date_format", "UNNEST": "explode", "LIST_CONTAINS": "array_contains", "LIST_SORT": "array_sort",
    "LIST_DISTINCT": "array_distinct", "LIST_CONCAT": "concat", "LIST_POSITION": "array_position", "LIST_UNIQUE": "array_distinct", "LIST_VALUE": "array", "LIST_TRANSFORM": "transform",
    "LIST_FILTER": "filter", "LIST_REDUCE": "reduce", "LIST_AGG": "collect_list", "LIST": "collect_list", "ARRAY_AGG": "collect_list", "MAP": "map_from_arrays", "JSON_EXTRACT_STRING": "get_json_object",
    "JSON_EXTRACT": "get_json_object", "STRPOS": "instr", "ARG_MIN": "min_by", "ARG_MAX": "max_by", "APPROX_QUANTILE": "percentile_approx", "EPOCH": "unix_timestamp", "STARTS_WITH": "startswith",
    "ENDS_WITH": "endswith", "PREFIX": "startswith", "SUFFIX": "endswith", "QUANTILE_CONT": "percentile", "BOOL_AND": "every", "BOOL_OR": "some", "GEN_RANDOM_UUID": "uuid", "TODAY": "current_date",
}
#: Functions of arrays that Spark lacks, as SQL functions that Catalyst inlines.
ARRAY_FUNCTIONS = {
    "array_distance": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "array_inner_product": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "array_cosine_distance": "1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))",
}
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%f": "SSSSSS", "%p": "a", "%I": "hh", "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE", "%%": "%"}
_ORDER_ENDS = {"LIMIT", "OFFSET", "ROWS", "RANGE", "GROUPS", "UNION", "INTERSECT", "EXCEPT", "FETCH", "QUALIFY", "WINDOW"}
_POSIX = {"digit": r"0-9", "alpha": r"a-zA-Z", "alnum": r"a-zA-Z0-9", "upper": r"A-Z", "lower": r"a-z", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"0-9A-Fa-f", "word": r"\w", "blank": r" \t", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}"}


def portable_regex(pattern: str) -> str:
    """A pattern of RE2's kind for Java: POSIX classes are translated, look-around and back references refused."""
    if re.search(r"\(\?(?:[=!>]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise QueryError("look-around and back references can't be used in a pattern")
    pattern = re.sub(r"\[:(\^?)(\w+):\]", lambda m: ("^" if m[1] else "") + _POSIX[m[2]] if m[2] in _POSIX else m[0], pattern)
    return pattern.replace("(?P<", "(?<")


def _next(ts: list[Token], i: int) -> int:
    while i < len(ts) and ts[i].kind in ("space", "comment"):
        i += 1
    return i


def _functions(ts: list[Token], lists: frozenset[int] = frozenset()) -> list[Token]:
    out, i, lens = [], 0, 0
    while i < len(ts):
        t = ts[i]
        j = _next(ts, i + 1)
        call = t.kind == "word" and j < len(ts) and ts[j].text == "(" and not (out and out[-1].text == ".")
        if call and t.key in ("READ_JSON", "READ_JSON_AUTO", "READ_PARQUET", "READ_CSV", "READ_CSV_AUTO"):
            k = _next(ts, j + 1)
            close = _next(ts, k + 1)
            if not (k < len(ts) and ts[k].kind == "string" and close < len(ts) and ts[close].text == ")"):
                raise QueryError(f"{t.text} takes one path")
            kind = {"J": "json", "P": "parquet", "C": "csv"}[t.key[5]]
            path = ts[k].text[1:-1].replace("''", "'").replace("`", "``")
            out.append(Token("op", f"{kind}.`{path}`"))
            i = close + 1
            continue
        if call and t.key == "STRFTIME":
            depth, k = 0, j
            while k < len(ts):
                depth += {"(": 1, ")": -1}.get(ts[k].text, 0)
                if ts[k].kind == "string" and depth == 1:
                    ts = [*ts[:k], Token("string", re.sub(r"%.", lambda m: _STRFTIME.get(m[0], m[0]), ts[k].text)), *ts[k + 1 :]]
                if not depth:
                    break
                k += 1
        if call and t.key == "LEN":
            out.append(Token("word", "size" if lens in lists else "length"))
            lens += 1
        elif call and t.key in FUNCTIONS:
            out.append(Token("word", FUNCTIONS[t.key]))
        elif t.kind == "number" and "." in t.text and "e" not in t.text.lower():
            near = [ts[k].text for k in (_next(ts, i + 1),) if k < len(ts)] + [o.text for o in reversed(out) if o.kind != "space"][:1]
            out.append(Token("number", t.text + ("D" if "/" in near else "")))  # a decimal that is divided gives a double
        else:
            out.append(t)
        i += 1
    return out


def _null_order(ts: list[Token]) -> list[Token]:
    """Nulls last for each sort key that doesn't say where they go."""
    out, i = [], 0
    while i < len(ts):
        out.append(ts[i])
        j = _next(ts, i + 1)
        if not (ts[i].kind == "word" and ts[i].key == "ORDER" and j < len(ts) and ts[j].key == "BY"):
            i += 1
            continue
        out += ts[i + 1 : j + 1]
        i, depth, key = j + 1, 0, []

        def flush():
            words = [t.key for t in key if t.kind == "word"]
            tail = []
            while key and key[-1].kind == "space":
                tail.append(key.pop())
            if key and "NULLS" not in words and words != ["ALL"]:
                key.append(Token("word", " NULLS LAST"))
            return [*_null_order(key), *tail]

        while i < len(ts):
            t = ts[i]
            if depth == 0 and (t.text == ")" or t.kind == "word" and t.key in _ORDER_ENDS):
                break
            depth += {"(": 1, ")": -1}.get(t.text, 0)
            if depth == 0 and t.text == ",":
                out += [*flush(), t]
                key = []
            else:
                key.append(t)
            i += 1
        out += flush()
    return out


def _qualify(ts: list[Token]) -> list[Token]:
    """SELECT ... QUALIFY condition: a subquery that keeps the condition as a column, filtered by it. Innermost first."""
    while True:
        depth, at, where = 0, None, 0
        for i, t in enumerate(ts):
            depth += {"(": 1, ")": -1}.get(t.text, 0)
            if t.kind == "word" and t.key == "QUALIFY" and (at is None or depth > where):
                at, where = i, depth
        if at is None:
            return ts
        depth, select = where, None
        for i in range(at - 1, -1, -1):
            depth -= {"(": 1, ")": -1}.get(ts[i].text, 0)
            if depth < where:
                break
            if depth == where and ts[i].key == "SELECT":
                select = i
                break
        if select is None:
            raise QueryError("QUALIFY without a SELECT")
        depth, source, end = where, None, len(ts)
        for i in range(select, at):
            depth += {"(": 1, ")": -1}.get(ts[i].text, 0)
            if depth == where and ts[i].key == "FROM" and source is None:
                source = i
        depth = where
        for i in range(at + 1, len(ts)):
            if depth == where and (ts[i].text == ")" or ts[i].key in ("ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "WINDOW")):
                end = i
                break
            depth += {"(": 1, ")": -1}.get(ts[i].text, 0)
        if source is None:
            raise QueryError("QUALIFY without a FROM")
        op = lambda s: Token("op", s)
        inner = [*ts[select:source], op(", ("), *ts[at + 1 : end], op(") AS __qualified "), *ts[source:at]]
        ts = [*ts[:select], op("SELECT * EXCEPT (__qualified) FROM ("), *inner, op(") WHERE __qualified "), *ts[end:]]


_ASOF_ENDS = {"WHERE", "GROUP", "ORDER", "LIMIT", "OFFSET", "HAVING", "QUALIFY", "WINDOW", "UNION", "INTERSECT", "EXCEPT", "JOIN", "LEFT", "RIGHT", "INNER", "FULL", "CROSS", "ASOF"}


def _solid(ts: list[Token]) -> list[Token]:
    return [t for t in ts if t.kind not in ("space", "comment")]


def _level(ts: list[Token], start: int, stop) -> int:
    """The first place from start on, outside brackets opened since, at which stop holds, or a bracket closes that was open before."""
    depth = 0
    for i in range(start, len(ts)):
        if depth == 0 and (ts[i].text == ")" or stop(ts[i])):
            return i
        depth += {"(": 1, ")": -1}.get(ts[i].text, 0)
    return len(ts)


def _relation(ts: list[Token]) -> tuple[str, str]:
    """A table or a subquery as text, and what it is called."""
    own = _solid(ts)
    if len(own) > 2 and own[-2].key == "AS" and own[-2].kind == "word":
        own = [*own[:-2], own[-1]]
    if not own or any(t.key in ("JOIN", ",") for t in own if t.text != "(") and own[0].text != "(":
        raise QueryError("ASOF JOIN joins the first two tables of a FROM")
    named = len(own) > 1 and own[-1].kind in ("word", "quoted") and own[-1].text != ")" and (own[-2].text != ".")
    if own[0].text == "(" and not named:
        raise QueryError("a subquery of an ASOF JOIN needs a name")
    return " ".join(t.text for t in (own[:-1] if named else own)), own[-1].text


def _asof(ts: list[Token]) -> list[Token]:
    """a ASOF [LEFT] JOIN b ON equalities AND a.t >= b.t: b's rows are run together with a's distinct keys and times in one window by key, which carries the last row of b on, and
    what each key and time then has is joined by equality. No pair of rows is compared."""
    at = next((i for i, t in enumerate(ts) if t.kind == "word" and t.key == "ASOF" and _solid(ts[i + 1 :])[:1] and _solid(ts[i + 1 :])[0].key in ("JOIN", "LEFT", "INNER")), None)
    if at is None:
        return ts
    depth, source = 0, None
    for i in range(at - 1, -1, -1):
        depth += {")": 1, "(": -1}.get(ts[i].text, 0)
        if depth < 0:
            break
        if depth == 0 and ts[i].kind == "word" and ts[i].key == "FROM":
            source = i
            break
    join = next(i for i in range(at, len(ts)) if ts[i].key == "JOIN")
    outer = any(t.key == "LEFT" for t in ts[at:join])
    on = _level(ts, join + 1, lambda t: t.kind == "word" and t.key in ("ON", "USING"))
    end = _level(ts, on + 1, lambda t: t.kind == "word" and t.key in _ASOF_ENDS)
    if source is None or on >= len(ts):
        raise QueryError("ASOF JOIN needs a FROM before it and ON or USING behind it")
    (left, a), (right, b) = _relation(ts[source + 1 : at]), _relation(ts[join + 1 : on])
    pairs = []
    if ts[on].key == "USING":
        names = [t.text for t in _solid(ts[on + 1 : end]) if t.kind in ("word", "quoted")]
        pairs = [(f"{a}.{n}", "=" if n != names[-1] else ">=", f"{b}.{n}") for n in names]
    else:
        i = on + 1
        while i < end:
            j = min(end, _level(ts, i, lambda t: t.kind == "word" and t.key == "AND"))
            part = _solid(ts[i:j])
            k = next((k for k, t in enumerate(part) if t.text in ("=", ">=", "<=", ">", "<")), None)
            if k is None:
                raise QueryError("an ASOF JOIN's condition is of comparisons joined by AND")
            x, y = part[:k], part[k + 1 :]
            of = lambda p, name: any(t.text == name and u.text == "." for t, u in zip(p, p[1:]))
            swap = of(x, b) or of(y, a)
            text = lambda p: "".join(t.text for t in p)
            pairs.append((text(y), {">=": "<=", "<=": ">=", ">": "<", "<": ">", "=": "="}[part[k].text], text(x)) if swap else (text(x), part[k].text, text(y)))
            i = j + 1
    times = [p for p in pairs if p[1] != "="]
    if len(times) != 1:
        raise QueryError("an ASOF JOIN has one inequality")
    (t_a, how, t_b), keys = times[0], [p for p in pairs if p[1] == "="]
    k = [f"__asof_k{i}" for i in range(len(keys))]
    own = "".join(f"{p[2]} AS {n}, " for p, n in zip(keys, k))
    theirs = "".join(f"{p[0]}, " for p in keys)
    by = f"PARTITION BY {', '.join(k)} " if k else ""
    order = f"__asof_t{' DESC' if how[0] == '<' else ''}, __asof_s{'' if '=' in how else ' DESC'}"
    run = (
        f"SELECT {''.join(f'{n}, ' for n in k)}__asof_t, __asof_s, last_value(__asof_r, true) OVER ({by}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __asof_r FROM "
        f"(SELECT {own}{t_b} AS __asof_t, 0 AS __asof_s, struct({b}.*) AS __asof_r FROM {right} {b} WHERE {t_b} IS NOT NULL UNION ALL SELECT DISTINCT {theirs}{t_a}, 1, NULL FROM {left} {a}) __asof_u"
    )
    found = f"(SELECT __asof_r.*, {''.join(f'{n}, ' for n in k)}__asof_t FROM ({run}) __asof_w WHERE __asof_s = 1 AND __asof_r IS NOT NULL) {b}"
    same = " AND ".join([*(f"{p[0]} = {b}.{n}" for p, n in zip(keys, k)), f"{t_a} = {b}.__asof_t"])
    select = next((i for i in range(source, -1, -1) if ts[i].kind == "word" and ts[i].key == "SELECT"), source)
    head = [Token("op", f"* EXCEPT ({', '.join([*k, '__asof_t'])})") if t.text == "*" and _solid(ts[select:i])[-1].text in ("SELECT", "select", ",") else t for i, t in enumerate(ts[: source + 1])]
    return _asof([*head, *tokens(f" {left} {a} {'LEFT ' if outer else ''}JOIN {found} ON {same} "), *ts[end:]])


@dataclass(frozen=True)
class RangeCount:
    """SELECT keys, count(*) FROM a JOIN b ON x BETWEEN lo AND hi GROUP BY keys. items: of each column the number of its key; None for the count."""

    a: str
    b: str
    x: str
    lo: str
    hi: str
    keys: tuple[str, ...]
    items: tuple[int | None, ...]


def range_count(sql: str) -> RangeCount | None:
    """The statement's parts, if it is one that counts the pairs of a range join and no more."""
    ts = [t for t in tokens(sql) if t.kind != "comment"]
    word = lambda *keys: lambda t: t.kind == "word" and t.key in keys
    own = [i for i, t in enumerate(ts) if t.kind != "space"]
    if not own or ts[own[0]].key != "SELECT" or any(t.text == "?" or t.kind == "word" and t.key == "SELECT" for t in ts[own[0] + 1 :]):
        return None
    at = [own[0]]
    for stop in ("FROM", "JOIN", "ON", "BETWEEN", "AND", "GROUP"):
        at.append(_level(ts, at[-1] + 1, word(stop)))
    by = _next(ts, at[-1] + 1)
    if by >= len(ts) or ts[by].key != "BY":
        return None
    select, a, b, x, lo, hi = (ts[i + 1 : j] for i, j in zip(at, at[1:]))
    keys = ts[by + 1 :]
    if a and word("INNER")(_solid(a)[-1]):
        a = _solid(a)[:-1]
        a = [u for t in a for u in (t, Token("space", " "))]
    joins = {"LEFT", "RIGHT", "FULL", "CROSS", "SEMI", "ANTI", "OUTER", "NATURAL", "INNER", "JOIN", "ASOF", "LATERAL", "WHERE", "USING", "TABLESAMPLE", ",", ";"}
    more = {"AND", "OR", "NOT", "CASE", "BETWEEN", "OVER", ";"}
    ends = {"HAVING", "ORDER", "LIMIT", "OFFSET", "QUALIFY", "WINDOW", "UNION", "INTERSECT", "EXCEPT", "WITH", "ALL", "ROLLUP", "CUBE", "GROUPING", ";"}
    if any(t.key in w for part, w in ((a, joins), (b, joins), (x, more), (lo, more), (hi, {*more, "WHERE", "JOIN"}), (keys, ends)) for t in part):
        return None

    def parts(own: list[Token]) -> list[list[Token]]:
        out, i = [], 0
        while i <= len(own):
            j = _level(own, i, lambda t: t.text == ",")
            out.append(_solid(own[i:j]))
            i = j + 1
        return out

    groups = [[t.text for t in g] for g in parts(keys)]
    items = []
    for item in parts(select):
        named = len(item) > 2 and item[-2].key == "AS" and item[-1].kind in ("word", "quoted", "tick")
        body = [t.text for t in (item[:-2] if named else item)]
        if [t.lower() for t in body] == ["count", "(", "*", ")"]:
            items.append(None)
        elif body in groups:
            items.append(groups.index(body))
        else:
            return None
    if any(not g or g[0][0].isdigit() for g in groups) or not all(_solid(p) for p in (a, b, x, lo, hi)):
        return None
    return RangeCount(*(text_of(p).strip() for p in (a, b, x, lo, hi)), tuple(" ".join(g).replace(" . ", ".") for g in groups), tuple(items))


def lens(sql: str) -> int:
    """How many calls of len, which is of strings or lists, there are."""
    ts = tokens(sql)
    return sum(t.kind == "word" and t.key == "LEN" and "".join(x.text for x in ts[_next(ts, i + 1) :][:1]) == "(" for i, t in enumerate(ts))


def translate(sql: str, lists: frozenset[int] = frozenset()) -> str:
    """The stage for Spark: functions and file readers renamed, null order spelt out, QUALIFY taken apart. lists: which calls of len are of lists."""
    ts = tokens(sql)
    words = [t.key for t in ts if t.kind == "word"]
    if words[:1] == ["SUMMARIZE"]:
        raise QueryError("SUMMARIZE isn't available; select the statistics that are wanted")
    if words[:1] == ["FROM"] and "SELECT" not in words:
        ts = [Token("word", "SELECT * "), *ts]
    return text_of(_null_order(_qualify(_functions(_asof(ts), lists))))
