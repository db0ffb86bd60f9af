"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import rules

_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate({{}}, '{_A_Z}', '{_a_z}')"
#: [\x20\x09-\x0D], as characters to strip.
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = rf"""
with bw as (select item_id, regexp_extract_all({_LOW.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
bwin as (select distinct item_id, list_slice(w, i, i + 12) g from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) i from bw where len(w) > 0)),
dw as (select doc_id, regexp_extract_all(coalesce({_LOW.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
sizes as (select distinct len(g) n from bwin),
dwin as (select doc_id, n, i, list_slice(w, i, i + n - 1) g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, sizes where len(w) >= n)),
hits as (select d.doc_id, d.i, d.n, b.item_id from dwin d join bwin b on d.g = b.g),
hit_words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
docw as (select doc_id, unnest(w) word, generate_subscripts(w, 1) p from dw),
freq as (select word, count(*) c from docw group by word),
rare as (select g, arg_min({{'word': word, 'j': j}}, c) r from (select g, unnest(g) word, generate_subscripts(g, 1) j from (select distinct g from bwin)) left join freq using (word) group by g having count(*) = count(c)),
cand as (select distinct doc_id, g, p - r.j + d s from rare join docw on docw.word = r.word, (select unnest([-1, 0, 1]) d)),
near as (select distinct doc_id, g from cand join dw using (doc_id) where s >= 1 and s + len(g) - 1 <= len(w)
 and list_bool_and(list_transform(range(1, len(g) + 1), lambda j: g[j] = w[s + j - 1] or (s + j > 2 and coalesce(g[j] = w[s + j - 2], false)) or coalesce(g[j] = w[s + j], false)))),
nears as (select doc_id, count(distinct item_id) n_near from near join bwin using (g) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) ids from (select distinct doc_id, item_id::varchar s from hits) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated, coalesce(n_near, 0)::bigint n_near
from dw left join hit_words using (doc_id) left join its using (doc_id) left join nears using (doc_id)
"""

OP4 = f"""
with l as (select doc_id, unnest(s) line, generate_subscripts(s, 1) pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) s from documents)),
k as (select *, {_LOW.format(f"trim(line, {_WHITE})")} key from l),
rep as (select key, min(doc_id) keeper from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
f as (select k.doc_id, pos, line, coalesce(k.doc_id <> keeper, false) gone from k left join rep using (key))
select doc_id, count(*)::bigint n_lines, count(*) filter (where gone)::bigint n_dropped,
sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) kept_sha256
from f group by doc_id
"""


OP6 = """
with d as (select doc_id, encode(coalesce(text, '')) b from documents),
w as (select doc_id, i, md5(array_slice(b, i + 1, i + 400)) k from (select doc_id, b, unnest(range(0, octet_length(b) - 399)) i from d where octet_length(b) >= 400)),
s as (select doc_id, i from w semi join (select k from w group by k having count(*) > 1) using (k)),
g as (select doc_id, i, sum(case when i - before <= 400 then 0 else 1 end) over (partition by doc_id order by i) run from (select *, lag(i) over (partition by doc_id order by i) before from s)),
r as (select doc_id, min(i) a, max(i) + 400 z from g group by doc_id, run),
cuts as (select doc_id, z lo, lead(a) over (partition by doc_id order by a) hi from r union all select doc_id, 0, min(a) from r group by doc_id),
kept as (select doc_id, string_agg(hex(array_slice(b, lo + 1, coalesce(hi, octet_length(b)))), '' order by lo) h from cuts join d using (doc_id) where lo < coalesce(hi, octet_length(b)) group by doc_id),
n as (select doc_id, sum(z - a) removed, count(*) spans from r group by doc_id)
select doc_id, octet_length(b)::bigint n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(spans, 0)::bigint n_spans, case when removed is null then sha256(b) else sha256(unhex(coalesce(h, ''))) end kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""


def _op10() -> str:
    """Features, votes and all rounds of EM, each round two steps over the vote patterns."""
    stops = ", ".join(f"'{w}'" for w in rules.STOP_WORDS.split())
    votes = ", ".join(f"case when {r.bad} then -1 when {r.good} then 1 else 0 end" for r in rules.RULES)
    a, g, b = rules.FIRST
    steps = []
    for k in range(rules.ROUNDS):
        if not k:
            steps.append(f"o0 as materialized (select v, any_value(n) n, {a!r}::double + {g!r}::double * count(*) filter (where x = 1) - {b!r}::double * count(*) filter (where x = -1) odds from long group by v)")
        else:
            steps.append(f"o{k} as materialized (select v, any_value(n) n, any_value(prior) + sum(ratio) odds from long join m{k - 1} using (j, x) group by v)")
        steps.append(f"p{k} as materialized (select v, n, 1 / (1 + exp(-odds)) p from o{k})")
        steps.append(f"t{k} as materialized (select sum(p * n) good, sum((1 - p) * n) bad from p{k})")
        steps.append(
            f"m{k} as materialized (select j, x, ln(((sum(p * l.n) + 1) / (any_value(good) + 3)) / ((sum((1 - p) * l.n) + 1) / (any_value(bad) + 3))) ratio, "
            f"any_value(ln((good + 1) / (bad + 1))) prior from long l join p{k} using (v), t{k} group by j, x)"
        )
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) l from d),
win as (select doc_id, i, xxh from (select doc_id, unnest(range(1, len(w) - 1)) i, w from w where len(w) > 3), lateral (select list_slice(w, i, i + 2) xxh)),
hit as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from win semi join (select doc_id, xxh from win group by all having count(*) > 1) using (doc_id, xxh)) group by doc_id),
f as (select doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(hit.n, 0)::bigint n_repeat_words,
 length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) n_upper, len(list_filter(w, lambda x: x in ({stops}))) n_stop,
 len(list_filter(w, lambda x: regexp_matches(x, '[^.!?][.!?]$'))) n_ends, len(l) n_lines_words from w left join hit using (doc_id)),
voted as (select *, [{votes}] v from f),
pat as materialized (select v, count(*)::double n from voted group by v),
long as materialized (select v, n, unnest(range(0, len(v))) j, unnest(v) x from pat),
{("," + chr(10)).join(steps)},
last as materialized (select v, any_value(prior) + sum(ratio) odds from long join m{rules.ROUNDS - 1} using (j, x) group by v)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words base_failed,
not (n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words) and 1 / (1 + exp(-odds)) >= 0.5 kept, round(1 / (1 + exp(-odds)), 4) p_good
from voted join last using (v)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op4_line_dedup": OP4, "op6_suffix_dedup": OP6, "op10_quality_rules": _op10()}
