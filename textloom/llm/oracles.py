"""DuckDB SQL of the queries of this package that SQL can express over whole tables."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = r"[^\x20\x09-\x0D]+"

_WORDS = "regexp_extract_all({0}, '{1}')"


def _words(table: str, key: str, pattern: str) -> str:
    return f"select {key}, coalesce({_WORDS.format(LOWER.format('text'), pattern)}, []) as w from {table}"


#: Windows of items meet the documents' word runs of the same length.
_OP1 = f"""with d as ({_words('documents', 'doc_id', _ALNUM)}), b as ({_words('benchmark', 'item_id', _ALNUM)}),
win as (select distinct item_id, least(len(w), 13) as k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct k from win),
run as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, lens where len(w) >= k)),
hit as (select r.doc_id, r.i, r.k, win.item_id from run r join win on r.g = win.g and r.k = win.k),
words as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(i, i + k)) as p from hit) group by 1),
items as (select doc_id, count(*) as n_items, sha256(string_agg(x, ',' order by x)) as h from (select distinct doc_id, item_id::varchar as x from hit where item_id is not null) group by 1)
select d.doc_id, len(d.w)::BIGINT as n_words, coalesce(n_hit, 0)::BIGINT as n_hit, coalesce(n_items, 0)::BIGINT as n_items, coalesce(h, sha256('')) as items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated from d left join words using (doc_id) left join items using (doc_id)"""

#: All pairs that share a shingle, and the smallest id that links reach.
_OP2 = f"""with recursive d as ({_words('documents', 'doc_id', _PLAIN)}),
s as (select distinct doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
link as (select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g and a.doc_id != b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach as (select doc_id as x, doc_id as y from d union select r.x, l.y from reach r join link l on r.y = l.x)
select d.doc_id, coalesce(n.n, 0)::BIGINT as n_shingles, c.component_id from d left join n using (doc_id) join (select x, min(y) as component_id from reach group by 1) c on c.x = d.doc_id"""

_OP9 = f"""with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
p as (select page_id, {LOWER.format("regexp_extract(r, '^[^/?#]*')")} as host, regexp_extract(regexp_extract(r, '^[^?#]*'), '^[^/]*(.*)$', 1) as path from u),
rules as (select * from (values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')) t(verdict, rule, h, s)),
f as (select page_id, rule, verdict, row_number() over (partition by page_id order by length(rule) desc) as k from p join rules on (host = h or suffix(host, '.' || h)) and prefix(path, s))
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join f on f.page_id = p.page_id and k = 1"""

#: All pairs of lines of 20 characters or more. DuckDB's distance counts bytes: other characters than ASCII are
#: exchanged for ones of ASCII that no document has.
_OP10 = """with chars as (select distinct unnest(string_split(text, '')) as c from documents),
odd as (select c, row_number() over (order by c) as k from chars where length(c) > 0 and ord(c) > 127),
free as (select c, row_number() over (order by c) as k from (select chr(i::INT) as c from range(1, 128) t(i)) where c not in (select c from chars)),
swap as (select coalesce(string_agg(odd.c, '' order by k), '') as a, coalesce(string_agg(free.c, '' order by k), '') as b from odd left join free using (k)),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents where text != ''),
f as (select line, length(line) as len, count(*) as copies, min({'d': doc_id, 'p': pos}) as spot from l where line != '' group by 1),
g as (select line, len, spot, translate(line, a, b) as s from f, swap where len >= 20),
near as (select distinct y.line from g x join g y on abs(x.len - y.len) <= 2 and x.spot < y.spot and levenshtein(x.s, y.s) <= 2),
judged as (select f.*, near.line is not null as near from f left join near on f.line = near.line),
stay as (select spot.d as doc_id, count(*) as firsts, count(*) filter (near) as n_near, sum(case when not near and len >= 20 then len else 0 end) as kept from judged group by 1),
sizes as (select doc_id, count(*) as n_lines, count(*) filter (length(line) >= 20) as n_long, count(*) filter (line != '') as n_judged from l group by 1)
select d.doc_id, coalesce(n_lines, 0)::BIGINT as n_lines, coalesce(n_long, 0)::BIGINT as n_long, (coalesce(n_judged, 0) - coalesce(firsts, 0))::BIGINT as n_copies, coalesce(n_near, 0)::BIGINT as n_near, coalesce(kept, 0)::BIGINT as kept_chars
from documents d left join sizes using (doc_id) left join stay using (doc_id)"""

_OP11 = """with d as (select doc_id, coalesce(text, '') as t from documents), g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)"""

_VECTORS = "(select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) as x from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0{0})"


def _rounds(name: str, count: int, entries: str, unit: str, assigned: str) -> str:
    """Rounds of Lloyd: {name}k assigns by the entries e(k-1) and ek has the means; unused entries stay."""
    out = []
    for k in range(1, count + 1):
        out.append(f"{name}{k} as materialized ({assigned.format(k - 1)})")
        means = f"select {unit}, j, q, floor(sum(c)::DOUBLE / count(*))::BIGINT as m from {name}{k} join cells using ({unit}, vec_id) group by 1, 2, 3"
        out.append(f"e{k} as materialized (select o.{unit}, o.j, o.q, coalesce(n.m, o.m) as m from e{k - 1} o left join ({means}) n on n.{unit} = o.{unit} and n.j = o.j and n.q = o.q)")
    return ",\n".join([f"e0 as materialized ({entries})", *out, f"last as materialized ({assigned.format(count)})"])


#: Plain rounds: every distance is computed; p is the part, j the entry and q the position in the part. No vector has repeated ids.
_NEAREST = "select p, vec_id, arg_min(j, (d, j)) as j, min(d) as d from (select p, vec_id, j, sum((c - m) * (c - m))::BIGINT as d from cells join e{0} using (p, q) group by 1, 2, 3) group by 1, 2"
_OP12 = f"""with v as materialized {_VECTORS.format('')},
cells as materialized (select vec_id, p, q, x[p * w + q + 1] as c from (select vec_id, x, len(x) // 4 as w, unnest(range(0, 4)) as p, range(0, len(x) // 4) as qs from v), unnest(qs) t(q)),
{_rounds('a', 4, 'select p, r as j, q, c as m from cells join (select vec_id, row_number() over (order by vec_id) - 1 as r from v) using (vec_id) where r < 256', 'p', _NEAREST)},
books as (select sha256(string_agg(m::VARCHAR, ',' order by p, j, q)) as h from e4),
codes as (select vec_id, string_agg(lpad(lower(to_hex(j)), 2, '0'), '' order by p) as code, sum(d)::BIGINT as error from last group by 1)
select vec_id, code, error, (sum(error) over (partition by label))::BIGINT as label_error, h as codebooks_sha256 from codes join v using (vec_id), books"""

_OP13 = f"""with v as materialized {_VECTORS.format(' and len(embedding) = 64')},
cells as materialized (select 0 as p, vec_id, q, x[q + 1] as c from v, unnest(range(0, 64)) t(q)),
{_rounds('a', 10, "select p, r as j, q, c as m from cells join (select vec_id, row_number() over (order by sha256('3:' || vec_id::VARCHAR)) - 1 as r from v) using (vec_id) where r < 8", 'p', _NEAREST)},
names as (select j, sha256(string_agg(m::VARCHAR, ',' order by q)) as h from e10 group by 1)
select vec_id, j::INT as cluster, d as distance, (sum(d) over (partition by j))::BIGINT as cluster_inertia, (sum(d) over ())::BIGINT as inertia, h as centroid_sha256 from last join names using (j)"""

SQL: dict[str, str] = {"op1_decontaminate": _OP1, "op2_ngram_join": _OP2, "op9_url_filter": _OP9, "op10_line_dedup": _OP10, "op11_exact_dedup": _OP11, "op12_vector_codes": _OP12, "op13_centroids": _OP13}
