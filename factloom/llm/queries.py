"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.bpe import bpe_round_trip
from factloom.llm.chat import format_conversations
from factloom.llm.common import table
from factloom.llm.curve import pack_along_curve
from factloom.llm.fingerprints import fingerprint_documents
from factloom.llm.jaccard import similar_components
from factloom.llm.packing import pack
from factloom.llm.quality import judge
from factloom.llm.repair import damage_and_repair
from factloom.llm.sharding import shard_documents
from factloom.llm.substrings import remove_repeats
from factloom.llm.token_counts import token_counts
from factloom.llm.token_files import token_file_round_trip
from factloom.llm.whitening import whiten

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
#: A conversation of control strings that op7 adds.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 2048, 0)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), 20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 0)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 512)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return format_conversations(rows.unionByName(probe)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), 4, 85)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(table(spark, sf_dir, "conversations"))


def op12_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), 2048, 1)


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack, op2_repeats, op3_token_files, op4_fingerprints, op5_token_counts, op6_shards, op7_chat, op8_jaccard, op9_bpe, op10_quality, op11_repair, op12_curve, op13_whiten, pipeline)}

_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '#', '\\h'), '<', '\\l')"

_CRC_STEP = "list_reduce(range(0, 8), lambda y, j: xor(y >> 1, (y & 1) * 3988292384), xor({0}, {1}))"
_LEAST = "list_sort(list_filter([{0}], lambda o: o is not null))[1]"


def _edit(letter: str, cost: str, target: str, put: str | None) -> str:
    """One edit before the repair ``target``: its cost, letter and the row that it leaves."""
    rows = f"list_prepend({put}, {target}.rows)" if put else f"{target}.rows"
    return f"case when {target} is null then null else {{'cost': {target}.cost + {cost}, 'audit': '{letter}' || {target}.audit, 'rows': {rows}}} end"


def _before_row(state: int) -> str:
    """The least repair from ``state`` on, behind which a row stands: the edits of the row, before insertions."""
    to, role = (3, "assistant") if state == 2 else (2, "user")
    step = {0: "case initial when 'u' then s2 when 's' then s1 end", 1: "case initial when 'u' then s2 end", 2: "case initial when 'a' then s3 end", 3: "case initial when 'u' then s2 end"}[state]
    kept, made = _edit("K", "more", f"({step})", "role || ':' || text"), _edit("R", "(1 + more)", f"s{to}", f"'{role}:' || text")
    return f"{_LEAST.format(', '.join([_edit('D', '2', f's{state}', None), f'case when stays then {kept} end', f'case when stays then {made} end']))} as p{state}"


_INSERT_USER, _INSERT_ASSISTANT = _edit("I", "5", "q2", "'user:'"), _edit("I", "5", "p3", "'assistant:'")

ORACLE_SQL: dict[str, str] = {
    "op11_repair": f"""
        with recursive source as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
        kinds as (
            select *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: cast(ascii(substring(k, i, 1)) as bigint)), lambda c, b: {_CRC_STEP.format("c", "b")}, 4294967295), 4294967295) % 20 as kind from source),
        damaged as (
            select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                unnest(range(0, case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from kinds),
        placed as (
            select *, left(role, 1) as initial, row_number() over w as i,
                lag(left(role, 1)) over w as before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
            from damaged window w as (partition by conv_id order by turn nulls first, role, text, copy)),
        counted as (select *, row_number() over (partition by conv_id, role, text order by i) as nth from placed),
        faulty as (select *, body = '' as blank, body <> '' and nth > 1 as duplicate, body <> '' and nth = 1 and right(body, 1) not in ('.', '!', '?') as truncated from counted),
        coded as (select *, not (blank or duplicate) as stays, case when truncated then 5 else 0 end as more from faulty),
        counts as (
            select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
                count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from coded group by 1),
        repairs as (
            select conv_id, n as i, {{'cost': 0, 'audit': '', 'rows': cast([] as varchar[])}} as s0, {{'cost': 10, 'audit': 'II', 'rows': ['user:', 'assistant:']}} as s1,
                {{'cost': 5, 'audit': 'I', 'rows': ['assistant:']}} as s2, {{'cost': 0, 'audit': '', 'rows': cast([] as varchar[])}} as s3 from counts
            union all
            select conv_id, i, {", ".join(f"{_LEAST.format(f'p{s}, {_INSERT_USER}')} as s{s}" for s in (0, 1))}, q2 as s2, {_LEAST.format(f"p3, {_INSERT_USER}")} as s3
            from (select *, {_LEAST.format(f"p2, {_INSERT_ASSISTANT}")} as q2
                from (select r.conv_id, c.i - 1 as i, {", ".join(_before_row(s) for s in range(4))} from repairs r join coded c on c.conv_id is not distinct from r.conv_id and c.i = r.i)))
        select cast(o.conv_id as bigint) as conv_id, cast(coalesce(c.gaps, 0) as bigint) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal,
            cast(coalesce(r.s0.cost, 0) as bigint) as cost, coalesce(r.s0.audit, '') as audit, sha256(coalesce(array_to_string(r.s0.rows, chr(10)), '')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join repairs r on r.conv_id is not distinct from o.conv_id and r.i = 0""",
    "op2_repeats": f"""
        with docs as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
        wide as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as p from docs where len(ws) >= 20),
        windows as (select doc_id, p, row_number() over (partition by array_to_string(ws[p:p + 19], ' ') order by doc_id, p) as nth from wide),
        covered as (select distinct doc_id, unnest(range(p, p + 20)) as i from windows where nth > 1),
        words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from docs),
        kept as (select w.doc_id, count(*) as n, string_agg(w.word, ' ' order by w.i) as t from words w left join covered c on c.doc_id = w.doc_id and c.i = w.i where c.i is null group by 1)
        select d.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
        from docs d left join kept k on k.doc_id = d.doc_id""",
    "op7_chat": f"""
        with rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' union all select {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')
        select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
            sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
            cast(sum(4 + length(replace({_ESCAPED.format("role")}, ':', '\\c')) + 2 + length({_ESCAPED.format("text")}) + 9) as bigint) as formatted_chars
        from rows group by 1""",
    "op8_jaccard": f"""
        with recursive docs as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
        shingles as (
            select distinct doc_id, array_to_string(ws[p:p + 3], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as p from docs where len(ws) > 0)),
        sizes as (select doc_id, count(*) as n from shingles group by 1),
        shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        both_ways as (select a, b from links union all select b, a from links),
        reach as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on l.a = r.b)
        select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, cast(least(d.doc_id, coalesce(r.low, d.doc_id)) as bigint) as component_id
        from docs d left join sizes s on s.doc_id = d.doc_id left join (select a, min(b) as low from reach group by 1) r on r.a = d.doc_id""",
}
