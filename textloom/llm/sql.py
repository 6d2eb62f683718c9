"""SQL for the queries of this package that SQL can state."""

from __future__ import annotations

_WS = r"\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_TERMS = r"""
latest as (
  select id, lemmas from articles where id is not null
  qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1
), elements as (
  select id, lower(trim(nfc_normalize(x), ' ' || chr(160) || chr(9) || chr(10) || chr(13))) as term
  from latest, unnest(lemmas) as u(x)
), terms as (
  select id, term from elements where regexp_matches(term, '\p{L}')
), counted as (
  select term, count(*) as occurrences, count(distinct id) as records from terms group by term
), whole as (select count(distinct id) as n from terms)
"""

_PAIRS = rf"""{_TERMS}, kept as (
  select distinct t.id, t.term, c.records from terms t join counted c using (term), whole where c.records >= 5 and c.records * 1000 >= n
), pairs as (
  select a.term as term_a, b.term as term_b, a.records as n_a, b.records as n_b, count(*) as n_ab
  from kept a join kept b on a.id = b.id and a.term < b.term group by all
), passing as (
  select *, n_ab / (n_a::double * n_b / n) as lift from pairs, whole
  where n_ab >= 5 and 1000 * n_ab >= n and n_ab * n >= 12 * n_a * n_b
)
"""

_LINES = rf"""
latest as (
  select id, url, text_deduped from articles where id is not null
  qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1
), sites as (
  select id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') as site, text_deduped from latest where url is not null
), lines as (
  select distinct id, site, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[{_WS}]+', ' ', 'g')) as line_key
  from sites, unnest(string_split(text_deduped, chr(10))) as u(l)
)
"""

# These expressions have no look-ahead. A run of two or more white spaces before a word
# is one token less its last character, which a mark (a private-use character) stands for.
_TOKENS = rf"""coalesce(len(regexp_extract_all(
  regexp_replace(text, '[{_WS}]+([{_WS}])([^{_WS}])', chr(57344) || '\1\2', 'g'),
  '\x{{e000}}|''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\x{{e000}}{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+')), 0)"""

_KEYED = rf"""
latest as (
  select id, url, text_deduped from articles where id is not null
  qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1
), sites as (
  select id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', ''), '') as site, text_deduped as text from latest
), keyed as (
  select id, site, pos, raw, trim(regexp_replace(regexp_replace(lower(raw), '[0-9]+', '0', 'g'), '[{_WS}]+', ' ', 'g')) as line
  from sites, unnest(string_split(text, chr(10))) with ordinality as u(raw, pos)
), single as (
  select site, line from keyed where site is not null and line <> '' group by site, line having count(distinct id) >= 5
)
"""

# windows of 200 characters that at least two documents have
_WINDOWS = rf"""
normal as (
  select doc_id, trim(regexp_replace(text, '[{_WS}]+', ' ', 'g')) as t from documents
), windows as (
  select doc_id, i, hash(substr(t, i, 200)) as h from (select * from normal where length(t) >= 200), unnest(range(1, length(t) - 198)) as u(i)
), several as (
  select h from windows group by h having min(doc_id) <> max(doc_id)
), shared as (
  select doc_id, i, h from windows where h in (select h from several)
)
"""

# the same windows of one text a class of copies, with the least class that has them
_CLASS_WINDOWS = rf"""
normal as (
  select doc_id, trim(regexp_replace(text, '[{_WS}]+', ' ', 'g')) as t from documents
), classes as (
  select min(doc_id) as doc, t from normal where length(t) >= 200 group by t
), windows as (
  select doc, i - 1 as i, hash(substr(t, i, 200)) as h from classes, unnest(range(1, length(t) - 198)) as u(i)
), several as (
  select h, min(doc) as least from windows group by h having min(doc) <> max(doc)
), shared as (
  select w.doc, w.i, w.h, s.least from windows w join several s using (h)
)
"""


def _given_votes() -> list[str]:
    voters = ("expert_annotator_1", "expert_annotator_2", "student_annotator_1", "student_annotator_2")
    given = " union all ".join(f"select id as item, '{c}' as who, try_cast(regexp_extract(trim({c}, ' ' || chr(160) || chr(9) || chr(10)), '^([123])_', 1) as int) as r from rated" for c in voters)
    return [
        "rated as (select * from ratings where id is not null qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1)",
        f"v as materialized (select * from ({given}) where r is not null)",
        "counted as materialized (select item, count(*) as n from v group by item)",
        "c as (select distinct item, r as t from v)",
    ]


def _log_odds_rounds(rounds: int) -> str:
    """Rounds with soft consensus: probabilities ``p``, and weights of votes below and above (``over``, ``under``)."""

    def weight(n: str, d: str) -> str:
        lower = f"greatest(0, {n} * power(1 - 2 / (9.0 * {n}) - 1.959963984540054 * sqrt(2 / (9.0 * {n})), 3))"
        error = f"least(1 / greatest({lower} / ({d} + 0.5), 1e-9), 2 / 3.0)"
        return f"greatest(ln((1 - {error}) * 2 / {error}), 1e-6)"

    steps = [
        *_given_votes(),
        "cells as materialized (select v.item, who, r, t from v, (select unnest([1, 2, 3]) as t))",
        "w0 as (select distinct who, 1.0::double as over, 1.0::double as under from v)",
    ]
    cost = "case when r < t then over when r > t then under else 0 end"
    for k in range(rounds):
        steps += [
            f"s{k} as materialized (select item, t, sum({cost}) as score from cells join w{k} using (who) group by item, t)",
            f"p{k} as materialized (select item, t, exp(least - score) / sum(exp(least - score)) over (partition by item) as p from (select *, min(score) over (partition by item) as least from s{k}))",
            f"""x{k} as materialized (select who, sum(p) filter (where t > 1) as no, coalesce(sum(p) filter (where r < t), 0) as do_, sum(p) filter (where t < 3) as nu, coalesce(sum(p) filter (where r > t), 0) as du
              from cells join p{k} using (item, t) group by who)""",
            f"w{k + 1} as materialized (select who, {weight('no', 'do_')} as over, {weight('nu', 'du')} as under from x{k})",
        ]
    steps += [
        f"final as (select item, t, sum({cost}) as score, sum((over + under) / 2) as whole from cells join w{rounds} using (who) group by item, t)",
        "chosen as materialized (select item, min(t) as t from (select *, min(score) over (partition by item) as least from final join c using (item, t)) where score <= least + 1e-9 * whole group by item)",
    ]
    return ", ".join(steps)


def _bound_rounds(rounds: int) -> str:
    """Rounds of confidence-aware truth discovery one by one: costs ``e``, distances ``d``, weights ``w``."""
    steps = [
        *_given_votes(),
        "cells as materialized (select v.item, who, r, t, n, abs(r - t) as d from v join c using (item) join counted using (item))",
        "w0 as (select distinct who, 1.0::double as w from v)",
    ]
    for k in range(rounds):
        steps += [
            f"e{k} as materialized (select cells.*, w * d as cost, sum(w * d) over (partition by item, t) as score, sum(w) over (partition by item, t) as whole from cells join w{k} using (who))",
            f"d{k} as materialized (select item, who, avg(d) as d from (select *, min(score - cost) over (partition by item, who) as least from e{k} where n > 1) where score - cost <= least + 1e-9 * whole group by item, who)",
            f"x{k} as (select who, count(*) as n, sum(d) as d from d{k} group by who)",
            f"""w{k + 1} as materialized (select who, greatest(raw / max(raw) over (), 1e-6) as w from (
              select who, n * power(1 - 2 / (9.0 * n) - 1.959963984540054 * sqrt(2 / (9.0 * n)), 3) / (d + 0.5) as raw from x{k}))""",
        ]
    steps += [
        f"final as (select item, t, sum(w * d) as score, sum(w) as whole from cells join w{rounds} using (who) group by item, t)",
        "chosen as materialized (select item, min(t) as t from (select *, min(score) over (partition by item) as least from final) where score <= least + 1e-9 * whole group by item)",
    ]
    return ", ".join(steps)


_ROUNDS = 40

ORACLE = {
    "p4_found": f"""with {_log_odds_rounds(_ROUNDS)}, gold as (select id as item, try_cast(regexp_extract(trim(gold_label, ' ' || chr(160) || chr(9) || chr(10)), '^([123])_', 1) as int) as g from rated)
        select item as id, ['1_hauptthema', '2_nebenthema', '3_kein_thema'][t] as label from chosen join counted using (item) join gold using (item) where n >= 3 and g is distinct from t""",
    "p4_annotators": f"""with {_log_odds_rounds(_ROUNDS)} select who as annotator, count(*) as n_votes, round(avg((r = t)::int), 6) as reliability, round(any_value((over + under) / 2), 1) as weight
        from v join chosen using (item) join w{_ROUNDS} using (who) group by who""",
    "p4_bound_consensus": f"""with {_bound_rounds(_ROUNDS)}, pairs as (select item, sum(k * (k - 1)) as same from (select item, r, count(*) as k from v group by item, r) group by item)
        select item as id, ['1_hauptthema', '2_nebenthema', '3_kein_thema'][t] as label, n::int as n_votes, round(case when n < 2 then 1.0 else same / (n * (n - 1)) end, 6) as agreement
        from chosen join counted using (item) join pairs using (item)""",
    "p4_bound_annotators": f"""with {_bound_rounds(_ROUNDS)} select who as annotator, count(*) as n_votes, round(avg((r = t)::int), 6) as reliability, round(any_value(w), 2) as weight
        from v join chosen using (item) join w{_ROUNDS} using (who) group by who""",
    "p10_classes": f"""with {_CLASS_WINDOWS}, members as (select doc_id, coalesce(doc, doc_id) as class from normal left join classes using (t)),
        linked as (select a.doc, count(distinct b.doc) as n from (select distinct doc, h from shared) a join (select distinct doc, h from shared) b on a.h = b.h and a.doc <> b.doc group by a.doc)
        select doc_id, class, count(*) over (partition by class) as n_copies, coalesce(n, 0) as n_links from members left join linked on doc = class""",
    # equal windows of one text that overlap are numbered, and meet those of the least class by number
    "p10_spans": f"""with {_CLASS_WINDOWS}, gaps as (
          select *, coalesce(i - lag(i) over (partition by h, doc order by i) >= 200, true)::int as apart from shared
        ), clusters as (
          select *, sum(apart) over (partition by h, doc order by i rows unbounded preceding) as cluster from gaps
        ), turns as (
          select *, row_number() over (partition by h, doc, cluster order by i) - 1 as turn from clusters
        ), firsts as (
          select h, turn, i as a, count(*) over (partition by h) as many from turns where doc = least and cluster = 1
        ), linked as (
          select t.least as doc_a, t.doc as doc_b, f.a, t.i as b from turns t join firsts f on t.h = f.h and t.turn % f.many = f.turn where t.doc <> t.least
        ), islands as (
          select *, a - row_number() over (partition by doc_a, doc_b, b - a order by a) as island from linked
        ) select doc_a, doc_b, min(a)::int as start_a, min(b)::int as start_b, (max(a) - min(a) + 200)::int as size from islands group by doc_a, doc_b, b - a, island""",
    "p10_found": f"""with {_WINDOWS} select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from (select distinct doc_id, h from shared) a
        join (select distinct doc_id, h from shared) b on a.h = b.h and a.doc_id < b.doc_id""",
    "p10_shared_parts": f"""with {_WINDOWS}, steps as (select doc_id, least(200, coalesce(lead(i) over (partition by doc_id order by i) - i, 200)) as n from shared),
        covered as (select doc_id, sum(n)::bigint as n from steps group by doc_id)
        select doc_id, coalesce(length(t), 0)::int as n_chars, coalesce(n, 0) as shared_chars, coalesce(coalesce(n, 0) / nullif(length(t), 0), 0) as shared_share
        from normal left join covered using (doc_id)""",
    "p6_sequences": f"""with {_KEYED}, ranked as (
          select k.id, k.site, row_number() over (partition by k.id order by k.pos) as r, k.line, s.line is not null as often
          from keyed k left join single s on k.site = s.site and k.line = s.line where k.line <> '' and k.site is not null
        ), runs as (
          select id, site, r, line, r - row_number() over (partition by id order by r) as run from ranked where often
        ), texts as (
          select id, site, list(line order by r) as lines from runs group by id, site, run
        ), parts as (
          select distinct id, site, array_to_string(lines[i:i + n - 1], chr(10)) as lines, n::int as n_lines
          from texts, unnest(range(1, len(lines) + 1)) as v(n), unnest(range(1, len(lines) - n + 2)) as u(i)
        ) select site, lines, n_lines, count(*) as n_documents from parts group by site, lines, n_lines having count(*) >= 5""",
    "p6_cleaned": f"""with {_KEYED}, marked as (select k.*, s.line is not null as gone from keyed k left join single s on k.site = s.site and k.line = s.line),
        made as (select id, coalesce(string_agg(raw, chr(10) order by pos) filter (where not gone), '') as clean, count(*) filter (where gone) as n from marked where site is not null group by id)
        select s.id, case when m.id is null then s.text else m.clean end as text_clean, coalesce(m.n, 0) as n_removed from sites s left join made m using (id)""",
    "p1_pair_counts": rf"""with latest as (
          select id, lemmas from articles where id is not null qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1
        ), elements as (
          select id, i, lower(trim(nfc_normalize(x), ' ' || chr(160) || chr(9) || chr(10) || chr(13))) as term from latest, unnest(lemmas) with ordinality as u(x, i)
        ), terms as (select * from elements where regexp_matches(term, '\p{{L}}')
        ), grams as (
          select id, term as ngram, 1 as n from terms union all
          select a.id, a.term || ' + ' || b.term, 2 from terms a join terms b on a.id = b.id and b.i = a.i + 1
        ) select ngram, n, count(*) as occurrences, count(distinct id) as records from grams group by ngram, n""",
    "p1_found": f"""with {_TERMS} select term, case when records <= 2 then 'rare' else 'common' end as mark
        from counted, whole where records <= 2 or records > 0.4 * n""",
    "p1_term_counts": f"""with {_TERMS} select term, occurrences, records,
        case when records <= 2 then 'rare' when records > 0.4 * n then 'common' end as mark from counted, whole""",
    "p6_found": f"with {_LINES} select site, line_key from lines where line_key <> '' group by all having count(*) >= 5",
    "p7_found": f"with {_PAIRS} select term_a, term_b from passing",
    "p7_pairs": f"with {_PAIRS} select term_a, term_b, n_a, n_b, n_ab, round(lift, 6) as lift from passing",
    "p8_found": f"select doc_id from documents where {_TOKENS} > 1024",
    "p5_counts": rf"""with plain as (select doc_id, coalesce(text, '') as t from documents),
        split as (select doc_id, t, list_filter(regexp_split_to_array(t, '[{_WS}\x{{1c}}-\x{{1f}}]+'), lambda x: x <> '') as words, list_filter(regexp_split_to_array(t, '\r\n|[\n\r\v\f\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[^{_WS}\x{{1c}}-\x{{1f}}]')) as lines from plain)
        select doc_id, length(t) as n_chars, len(words) as n_words, len(lines) as n_lines, round(case when len(words) > 0 then list_sum(list_transform(words, lambda w: length(w))) / len(words) else 0 end, 6) as mean_word_length from split""",
    "p8_parts": f"""with sized as (select doc_id, {_TOKENS} as n from documents), parts as (select doc_id, n, ceil(n / 1024)::int as n_parts, unnest(range(0, ceil(n / 1024)::bigint)) as part from sized where n > 0)
        select doc_id, part::int as part, n_parts, part * 1024 as start, least(1024, n - part * 1024) as length from parts""",
    "p9_targets": f"""with sized as (select lower(trim(source)) as source, {_TOKENS} as n from documents),
        whole as (select sum(n)::bigint as n from sized), own as (select source, sum(n)::bigint as n from sized group by source)
        select m.source, m.target_share, m.max_repeats::bigint as max_repeats, whole.n as total_tokens, coalesce(own.n, 0) as available_tokens, round(m.target_share * whole.n, 3) as target_tokens,
          m.target_share * whole.n > m.max_repeats * coalesce(own.n, 0) as short from mix_targets m left join own using (source), whole""",
    "p9_found": f"""with sized as (select lower(trim(source)) as source, {_TOKENS} as n from documents),
        whole as (select sum(n) as n from sized), own as (select source, sum(n) as n from sized group by source)
        select m.source from mix_targets m left join own using (source), whole
        where m.target_share * whole.n > m.max_repeats * coalesce(own.n, 0)""",
}
