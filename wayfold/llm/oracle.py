"""DuckDB SQL of the queries that SQL can express."""

_QUANTISED = """
q as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
"""

_OP1 = f"""
with {_QUANTISED},
s as (select a.vec_id query_id, b.vec_id, cast(list_inner_product(a.v, b.v) as bigint) score
      from q a join q b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 5
"""

_OP2 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
              else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) s from w),
n as (select doc_id, count(*) n from sh group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) i from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a)
select r.a doc_id, coalesce(max(n.n), 0)::bigint n_shingles, min(r.b) component_id from r left join n on n.doc_id = r.a group by r.a
"""

_OP3 = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
                  greatest(0.25, coalesce(pow(length(translate(text, '#$%&*|<>{}[]\^~_=+@', '')) / greatest(length(text), 1)::double, 4), 0.25)) w,
                  (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':17'), 1, 12))::bigint + 0.5) / 281474976710656.0::double u from documents),
s as (select source, sum(size)::bigint source_size, (row_number() over (order by source is null, source) - 1) % 3 + 1.0 w from d group by source),
t as (select *, 3.0 * source_size cap, 3.0 * source_size / w ratio, sum(source_size) over () all_size, sum(w) over () all_w,
             coalesce(sum(3.0 * source_size) over (order by 3.0 * source_size / w, source is null, source rows between unbounded preceding and 1 preceding), 0) cap_before,
             coalesce(sum(w) over (order by 3.0 * source_size / w, source is null, source rows between unbounded preceding and 1 preceding), 0) w_before from s),
l as (select *, (all_size::double - cap_before::double) / (all_w::double - w_before::double) level from t),
f as (select source, source_size, least(cap::double, coalesce((select min_by(level, ratio) from l where ratio::double >= level) * w::double, cap::double)) target from l),
k as (select d.doc_id, d.source, d.size, f.source_size, f.target, case when f.source_size > 0 then floor(f.target / f.source_size)::bigint else 0 end epochs,
             coalesce(sum(d.size) over (partition by d.source order by -ln(u) / d.w, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint before
      from d join f on d.source is not distinct from f.source)
select doc_id, size::bigint size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - before)))::bigint taken from k
"""

_OP8 = r"""
with a as (select page_id, case when url is null or position('://' in url) = 0 then null else substr(url, position('://' in url) + 3) end rest from pages),
b as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
             coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') path from a),
rules(verdict, rhost, rpath) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m as (select page_id, max_by(rhost || rpath, length(rhost || rpath)) rule, max_by(verdict, length(rhost || rpath)) verdict
      from b join rules on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath) group by page_id)
select b.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') verdict from b left join m using (page_id)
"""

SQL = {"op1_topk": _OP1, "op2_jaccard": _OP2, "op3_mixing": _OP3, "op8_url_filter": _OP8}
