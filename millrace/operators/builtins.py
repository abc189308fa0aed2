"""search, scan, grep, sh, jq, watch and ingest."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.retrieval import search_table
from ..plans.dialect import portable_regex
from ..schema import IDENTIFIER
from .base import Cap, Middle, Operator, Source, take


class Search(Source):
    """search <table> '<text>' [--col c] [--k n]: the n best rows by vectors and words, with _score."""

    name = "search"

    def parse_args(self, argv):
        a = take(argv, "search", 2, col="", k=100)
        if a.k <= 0:
            raise QueryError("--k is above 0")
        return a

    def prepare(self, args, ctx):
        args.table, args.text = args.given
        spec = ctx.schema.table(args.table)
        if args.col and args.col not in spec.searchable:
            raise QueryError(f"{args.table}.{args.col} isn't searchable")
        if not args.col and len(spec.searchable) != 1:
            raise QueryError(f"{args.table} has {len(spec.searchable)} searchable columns; name one with --col")
        args.col = args.col or spec.searchable[0]
        args.vector = ctx.embedding.embed([args.text])[0]
        args.terms = ctx.embedding.tokenize(args.text)

    def to_df(self, args, ctx):
        spec = ctx.schema.table(args.table)
        physical = ctx.store.physical(ctx.spark, args.table, hidden=True)
        window = ctx.store.window(ctx.ds_start, ctx.ds_end)
        return search_table(physical, window, spec.primary, spec.visible, f"_tok_{args.col}", f"_vec_{args.col}", args.terms, args.vector, args.k, 4 * args.k if ctx.ds_end else args.k, ctx.store.postings(ctx.spark, args.table, args.col))


class Scan(Source):
    """scan <table>: its visible rows."""

    name = "scan"

    def parse_args(self, argv):
        return take(argv, "scan", 1)

    def to_df(self, args, ctx):
        return ctx.store.visible(ctx.spark, args.given[0], ctx.ds_start, ctx.ds_end)


class Grep(Middle):
    """grep '<regex>' --field <col>: rows in which the pattern is found anywhere in the column's text."""

    name = "grep"

    def parse_args(self, argv):
        a = take(argv, "grep", 1, field="")
        if not IDENTIFIER.match(a.field):
            raise QueryError("grep needs --field with a column")
        return a

    def to_df(self, prev, args, ctx):
        if args.field not in prev.columns:
            raise QueryError(f"there is no column {args.field!r}")
        return prev.where(F.col(f"`{args.field}`").cast("string").rlike(portable_regex(args.given[0])))


class Sh(Operator):
    """sh '<command>': all rows as JSON lines through a shell command."""

    name, caps = "sh", frozenset({Cap.EXEC})

    def parse_args(self, argv):
        return take(argv, "sh", 1)

    def to_argv(self, args):
        return ["/bin/sh", "-c", args.given[0]]


class Jq(Operator):
    """jq '<script>': all rows as JSON lines through jq."""

    name, caps = "jq", frozenset({Cap.EXEC})

    def parse_args(self, argv):
        return take(argv, "jq", 1)

    def to_argv(self, args):
        return ["jq", "-c", args.given[0]]

    def by_row(self, args):
        """Whether the script sees one row after the other: it doesn't read on, count them or end early by itself."""
        return not re.search(r"\b(?:inputs?|input_line_number|halt|halt_error|limit|first|label|foreach|debug|stderr)\b", args.given[0])


class Watch(Operator):
    """watch '<glob>' [--poll-ms n]: new whole lines of the matching files, without end."""

    name, caps, bounded = "watch", frozenset({Cap.FS_READ}), False

    def parse_args(self, argv):
        return take(argv, "watch", 1, poll_ms=200, least_poll_ms=20)


class Ingest(Operator):
    """ingest <table> [--batch n] [--flush-ms n]: insert each micro-batch, known keys left out."""

    name, sink = "ingest", True

    def parse_args(self, argv):
        return take(argv, "ingest", 1, batch=64, flush_ms=200, least_batch=1, least_flush_ms=20)


BUILTINS = [Search, Scan, Grep, Sh, Jq, Watch, Ingest]
