"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .decontamination import op6_decontamination
from .near_duplicates import op5_minhash_near_dedup
from .personal import op8_personal_data
from .previous_factors import op11_suffix_array_dedup
from .quality import op7_quality_classifier
from .ranked_search import op13_ranked_search
from .secrets import op10_secret_scan
from .segmentation import op3_sentencepiece
from .spots import near_spot_classes, op9_spot_fingerprints
from .substrings import op2_substring_dedup
from .token_files import op4_token_files
from .tokenizer_alignment import op12_tokenizer_alignment
from .wrappers import op1_html_extraction

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_substring_dedup,
        op3_sentencepiece,
        op4_token_files,
        op5_minhash_near_dedup,
        op6_decontamination,
        op7_quality_classifier,
        op8_personal_data,
        op9_spot_fingerprints,
        op10_secret_scan,
        op11_suffix_array_dedup,
        op12_tokenizer_alignment,
        op13_ranked_search,
        near_spot_classes,
    )
}
_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_TEXT = "coalesce(text, '')"
_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op2_substring_dedup": f"""with w as (select doc_id, {_WORDS.format(_TEXT)} as a from documents),
win as (select doc_id, a, unnest(range(1, len(a) - 33)) as i from w where len(a) >= 35),
h as (select doc_id, i, md5(array_to_string(a[i : i + 34], ' ')) as h from win),
again as (select h from h group by h having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from h join again using (h)),
g as (select doc_id, list(p) as ps from gone group by doc_id)
select doc_id, len(a) as n_words, coalesce(len(ps), 0) as n_removed,
 sha256(coalesce(array_to_string(case when ps is null then a else list_filter(a, lambda x, i: not list_contains(ps, i)) end, ' '), '')) as kept_sha256 from w left join g using (doc_id)""",
    "op5_minhash_near_dedup": f"""with recursive w as (select doc_id, {_WORDS.format(_LOWER)} as a from documents),
s as (select doc_id, case when len(a) >= 5 then list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i : i + 4], ' '))) when len(a) > 0 then [array_to_string(a, ' ')] else [] end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
c as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from c where 100 * k >= 85 * (na + nb - k)),
near as (select a, b from l union all select b, a from l),
reach as (select doc_id as node, doc_id as root from s union select near.b, reach.root from reach join near on near.a = reach.node)
select s.doc_id, len(sh) as n_shingles, min(root) as component_id, s.doc_id = min(root) as kept from s join reach on reach.node = s.doc_id group by s.doc_id, len(sh)""",
    "op11_suffix_array_dedup": """with d as (select doc_id, strlen(coalesce(text, '')) as n, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, n, c, substr(h, 2 * c + 1, 498) as part from (select doc_id, n, h, unnest(range(0, n - 49, 200)) as c from d where n >= 50)),
s as (select doc_id, c + i as i, substr(part, 2 * i + 1, 100) as s from (select doc_id, c, part, unnest(range(least(200, n - 49 - c))) as i from c)),
f as (select s, min(doc_id) as first from s group by s having min(doc_id) < max(doc_id)),
g as (select doc_id, i from s join f using (s) where doc_id > first),
o as (select doc_id, i, lag(i) over w as before, lead(i) over w as behind from g window w as (partition by doc_id order by i)),
e as (select doc_id, i, sum(case when before is null or i - before > 50 then 1 else 0 end) over (partition by doc_id order by i) as run, least(50, coalesce(behind - i, 50)) as own from o),
r as (select doc_id, run, min(i) as a, max(i) + 50 as z from e group by doc_id, run),
k as (select doc_id, sum(z - a)::bigint as n_removed, count(*) as n_spans, list(a order by a) as a, list(z order by a) as z from r group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
 sha256(unhex(case when a is null then h else array_to_string(list_transform(range(1, len(a) + 2), lambda x: case when x = 1 then substr(h, 1, 2 * a[1]) when x > len(a) then substr(h, 2 * z[len(a)] + 1) else substr(h, 2 * z[x - 1] + 1, 2 * (a[x] - z[x - 1])) end), '') end)) as kept_sha256 from d left join k using (doc_id)""",
    "op13_ranked_search": f"""with t as (select doc_id, {_TERMS.format('text')} as a from documents where text is not null),
d as (select doc_id, len(a) as n, a from t where len(a) > 0),
c as (select count(*) as n_docs, cast(sum(n) as bigint) as l from d),
p as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(a) as term from d) group by all),
i as (select distinct item_id, unnest({_TERMS.format('text')}) as term from benchmark where text is not null),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from p, c where term in (select term from i) group by term, n_docs),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // l))))) as bigint) as score from i join w using (term) join p using (term), c group by item_id, doc_id),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 50""",
}
