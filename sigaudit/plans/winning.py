"""Queries of the evaluation over winners, over the labelled documents, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rng import bits as draw_bits
from ..operators import scoring, winners
from ..sources import adapters as src
from .oracle import bits, counts, f1

SEED, MOST = 1337, 4


def _tables(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled documents as rows, a dataset a language: one in ten is shown and the others are asked; and a winner a dataset, drawn: its
    template and two, four or no shots."""
    docs = src.table(s, d, "documents").join(src.table(s, d, "labels").select("doc_id", "quality"), "doc_id").where("text is not null and lang is not null and quality is not null")
    rows = docs.select(F.col("lang").alias("dataset"), F.col("source").alias("subject"), F.col("doc_id").cast("string").alias("window_id"), F.col("quality").cast("int").alias("y"), F.col("text").alias("body"), (draw_bits(SEED, "shown", F.col("doc_id")) % 10 == 0).alias("is_shown"))
    pool = rows.where("is_shown").select("dataset", "body", F.when(F.col("y") == 1, "B").otherwise("A").alias("token"), draw_bits(SEED, "place", F.col("window_id")).alias("place"), "window_id")
    names = F.array(*map(F.lit, text.TEMPLATES))
    drawn = rows.where("not is_shown").select("dataset").distinct().select("dataset", F.get(names, (draw_bits(SEED, "template", F.col("dataset")) % len(text.TEMPLATES)).cast("int")).alias("template_id"), (2 * (draw_bits(SEED, "shots", F.col("dataset")) % 3)).cast("int").alias("n_shot"))
    shown = winners.exemplar_lists(pool, ["dataset"], ["place", "window_id"], MOST)
    # a dataset with fewer exemplars than shots is asked without any
    known = drawn.join(shown.select("dataset", F.size("shown").alias("have")), "dataset", "left")
    won = known.select("dataset", "template_id", F.when(F.coalesce("have", F.lit(0)) >= F.col("n_shot"), F.col("n_shot")).otherwise(F.lit(0)).alias("n_shot"))
    return rows.where("not is_shown").drop("is_shown"), won, shown


def winner_prompts(s, d):
    """Every row's prompt by its dataset's winner."""
    got = winners.prompts_of_winners(*_tables(s, d), ["dataset"])
    return got.select("dataset", "window_id", "template_id", "n_shot", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"))


def winner_cells(s, d):
    """The winners' cells, scored by a stand-in that reads the exemplars."""
    rows = winners.evaluate(*_tables(s, d), ["dataset"], winners.overlap_scorer()).withColumn("m", F.round(F.col("logprob_a") - F.col("logprob_b"), 9)).withColumn("yhat", F.when(~F.col("failure"), (F.col("m") < 0).cast("int")))
    return scoring.summarise(rows, ["dataset", "template_id", "n_shot"]).select("dataset", "template_id", "n_shot", "n_scored", "n_failures", F.round("macro_f1", 6).alias("macro_f1"))


QUERIES = {f.__name__: f for f in (winner_prompts, winner_cells)}

_NAMES = ", ".join(f"'{t}'" for t in text.TEMPLATES)


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_PROMPT = "case template_id " + " ".join(
    f"when '{name}' then {_literal(t.replace('{choice}', text.CHOICE.format(a='calm', b='stress')).partition('{exemplars}')[0])} || shown_text || body || {_literal(t.partition('{body}')[2])}" for name, t in text.TEMPLATES.items()
) + " end"
_ROWS = f"""labelled as (select d.lang as dataset, d.source as subject, cast(d.doc_id as varchar) as window_id, cast(l.quality as int) as y, d.text as body, {bits('1337', "'shown'", 'd.doc_id')} % 10 = 0 as is_shown from documents d join labels l using (doc_id) where d.text is not null and d.lang is not null and l.quality is not null),
pool as (select dataset, body, case when y = 1 then 'B' else 'A' end as token, {bits('1337', "'place'", 'window_id')} as place, window_id from labelled where is_shown),
turns as (select *, row_number() over (partition by dataset, token order by place, window_id) as turn from pool),
places as (select *, row_number() over (partition by dataset order by turn, token) as nth from turns where turn <= {MOST}),
drawn as (select dataset, [{_NAMES}][{bits('1337', "'template'", 'dataset')} % {len(text.TEMPLATES)} + 1] as template_id, cast(2 * ({bits('1337', "'shots'", 'dataset')} % 3) as int) as wanted from (select distinct dataset from labelled where not is_shown)),
won as (select dataset, template_id, case when (select count(*) from places p where p.dataset = drawn.dataset and p.nth <= {MOST}) >= wanted then wanted else 0 end as n_shot from drawn),
taken as (select p.* from places p join won w on w.dataset = p.dataset and p.nth <= w.n_shot),
lists as (select dataset, 'Examples:' || chr(10) || string_agg(body || chr(10) || 'Answer: ' || token || chr(10), '' order by nth) || chr(10) as shown_text from taken group by dataset),
asked as (select l.*, w.template_id, w.n_shot, coalesce(s.shown_text, '') as shown_text from labelled l join won w using (dataset) left join lists s using (dataset) where not is_shown)"""
_WORDS = r"list_distinct(regexp_extract_all({x}, '[^\x20\x09-\x0D]+'))"
_CELLS = f"""bags as (select window_id, dataset, template_id, n_shot, y, {_WORDS.format(x='body')} as w from asked),
shown_bags as (select dataset, token, {_WORDS.format(x='body')} as w from taken),
near as (select b.window_id, b.dataset, b.template_id, b.n_shot, b.y, 1 + coalesce(sum(len(list_intersect(b.w, s.w)) / greatest(len(s.w), 1)::double) filter (token = 'A'), 0) as a, 1 + coalesce(sum(len(list_intersect(b.w, s.w)) / greatest(len(s.w), 1)::double) filter (token = 'B'), 0) as b from bags b left join shown_bags s using (dataset) group by all),
told as (select *, cast(round(ln(a / (a + b)) - ln(b / (a + b)), 9) < 0 as int) as yhat from near)"""
SQL = {
    "winner_prompts": f"with {_ROWS} select dataset, window_id, template_id, n_shot, sha256({_PROMPT}) as prompt_sha256 from asked",
    "winner_cells": f"with {_ROWS}, {_CELLS}, st as (select dataset, template_id, n_shot, count(*) as n_scored, {counts()} from told group by 1, 2, 3) select dataset, template_id, n_shot, n_scored, 0::bigint as n_failures, round({f1()}, 6) as macro_f1 from st",
}
