"""A pipeline's stages put on one another as one plan; Catalyst sees through them. A seam is only where rows leave for a process."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..errors import MillraceError, QueryError, ReadOnlyError
from ..functions.joins import count_within
from ..operators.base import Context, Operator, words_of
from ..operators.policy import Policy
from ..operators.process import through
from ..operators.registry import Registry
from .dialect import ARRAY_FUNCTIONS, lens, range_count, translate
from .guard import check_read
from .lex import leading_word, placeholders, split_pipeline


@dataclass
class Stage:
    text: str
    operator: Operator | None
    args: object = None


def compile_stages(text: str, registry: Registry, policy: Policy, ctx: Context, streaming: bool = False) -> list[Stage]:
    """Stages with their operators authorised and their arguments parsed; whatever can be wrong without reading data is raised here."""
    stages = []
    for i, part in enumerate(split_pipeline(text)):
        operator = registry.find(leading_word(part))
        if operator is None:
            stages.append(Stage(part, None))
            continue
        policy.authorize(operator)
        if not streaming and not operator.bounded:
            raise QueryError(f"{operator.name} never ends; it belongs in a stream")
        if not streaming and operator.sink:
            raise QueryError(f"{operator.name} ends a stream; a query only reads")
        if operator.is_source() and i:
            raise QueryError(f"{operator.name} can only come first")
        if not operator.is_source() and not i:
            raise QueryError(f"{operator.name} needs a stage before it")
        args = operator.parse_args(words_of(part)[1:])
        operator.prepare(args, ctx)
        stages.append(Stage(part, operator, args))
    return stages


def register_tables(ctx: Context) -> None:
    """Views of the request's own session: each table as its window shows it, and behind _all_ all its rows."""
    for spec in ctx.schema.tables:
        ctx.store.visible(ctx.spark, spec.name, ctx.ds_start, ctx.ds_end).createOrReplaceTempView(spec.name)
        ctx.store.physical(ctx.spark, spec.name).createOrReplaceTempView(f"_all_{spec.name}")


def register_functions(spark: SparkSession, sql: str) -> None:
    """Those of the functions that Spark lacks which the stage names."""
    for name, body in ARRAY_FUNCTIONS.items():
        if name in sql.lower():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SORTED = (*_WHOLE, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
_KEYS = (*_SORTED, T.FloatType, T.StringType, T.BooleanType, T.DecimalType)


def without_pairs(spark: SparkSession, sql: str, made: DataFrame) -> DataFrame:
    """The same rows for a statement that only counts the pairs of a range join, which are as many as the product of its sides; any other as it is."""
    r = range_count(sql)
    if r is None:
        return made
    keys = [f"__k{i}" for i in range(len(r.keys))]
    for spans, points in ((r.a, r.b), (r.b, r.a)):
        try:
            own = spark.sql(f"SELECT {', '.join(f'{g} AS {k}' for g, k in zip(r.keys, keys))}, {r.lo} AS __lo, {r.hi} AS __hi FROM {spans}")
            other = spark.sql(f"SELECT {r.x} AS __x FROM {points}")
        except (AnalysisException, ParseException):
            continue
        kinds = [own.schema["__lo"].dataType, own.schema["__hi"].dataType, other.schema["__x"].dataType]
        if all(isinstance(k, (*_WHOLE, T.DoubleType)) for k in kinds):  # compared as the wider of them, as in SQL
            wide = "double" if any(isinstance(k, T.DoubleType) for k in kinds) else "bigint"
            own, other = own.withColumns({c: F.col(c).cast(wide) for c in ("__lo", "__hi")}), other.withColumn("__x", F.col("__x").cast(wide))
        elif len(set(kinds)) > 1 or not isinstance(kinds[0], _SORTED):
            continue
        if not all(isinstance(own.schema[k].dataType, _KEYS) for k in keys):
            continue
        found = count_within(own, other, keys)
        return found.select(*[F.col("__n" if i is None else keys[i]).alias(c) for i, c in zip(r.items, made.columns)])
    return made


def run_sql(ctx: Context, sql: str, params: list, policy: Policy, prev: DataFrame | None, piped: bool) -> DataFrame:
    if prev is not None:
        prev.createOrReplaceTempView("_in")
    first = translate(sql)
    check_read(ctx.spark, sql, first, policy.may_read_files, QueryError if piped else ReadOnlyError)
    register_functions(ctx.spark, sql)
    n, failed = lens(sql), None
    for choice in product((False, True), repeat=min(n, 6)):  # which calls of len are of lists shows when the types are known
        try:
            translated = translate(sql, frozenset(i for i, is_list in enumerate(choice) if is_list))
            made = ctx.spark.sql(translated, args=params) if params else ctx.spark.sql(translated)
            return without_pairs(ctx.spark, translated, made)
        except (AnalysisException, ParseException) as e:
            failed = failed or e
            if "DATATYPE_MISMATCH" not in str(e):
                break
    raise QueryError(str(failed).strip().split("\n")[0]) from failed


def build(text: str, params: list | None, registry: Registry, policy: Policy, ctx: Context) -> DataFrame:
    """The pipeline as a lazy DataFrame; process stages run at once."""
    ctx.store.window(ctx.ds_start, ctx.ds_end)
    stages = compile_stages(text, registry, policy, ctx)
    params = list(params or ())
    wanted = sum(placeholders(s.text) for s in stages if s.operator is None)
    if wanted != len(params):
        raise QueryError(f"the pipeline has {wanted} placeholder(s) and {len(params)} parameter(s)")
    if any(s.operator is None for s in stages):
        register_tables(ctx)
    df: DataFrame | None = None
    i = 0
    while i < len(stages):
        s = stages[i]
        if s.operator is None:
            n = placeholders(s.text)
            df = run_sql(ctx, s.text, params[:n], policy, df, len(stages) > 1)
            params = params[n:]
        elif s.operator.has("to_df"):
            df = s.operator.to_df(s.args, ctx) if s.operator.is_source() else s.operator.to_df(df, s.args, ctx)
        else:  # neighbouring processes are one chain
            argvs, by_row = [], True
            while i < len(stages) and stages[i].operator is not None and not stages[i].operator.has("to_df"):
                argvs.append(stages[i].operator.to_argv(stages[i].args))
                by_row = by_row and stages[i].operator.has("by_row") and stages[i].operator.by_row(stages[i].args)
                i += 1
            df = through(df, argvs, policy.process_timeout_s, by_row)
            continue
        i += 1
    return df


def explain(text: str, registry: Registry) -> list[str]:
    """How the stages are carried out, a line each."""
    out = []
    for part in split_pipeline(text):
        o = registry.find(leading_word(part))
        out.append(f"{'sql' if o is None else o.name}: {'Catalyst' if o is None or o.has('to_df') else 'process' if o.has('to_argv') else 'stream'}")
    return out


def collect(df: DataFrame) -> list[dict]:
    try:
        return [r.asDict(True) for r in df.collect()]
    except MillraceError:
        raise
    except PySparkException as e:
        raise QueryError(str(e).strip().split("\n")[0]) from e
