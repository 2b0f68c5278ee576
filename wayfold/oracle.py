"""DuckDB SQL of the registered queries, over the same star-schema view."""

_VIEW = """
with refs0 as (
  select l_orderkey way_id, l_partkey * 100000 + l_suppkey node_id, l_partkey, l_suppkey,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) pos,
         count(*) over (partition by l_orderkey) n0
  from lineitem),
refs as (
  select way_id, node_id, pos, n0 + case when way_id % 4 = 0 then 1 else 0 end n from refs0
  union all select way_id, node_id, n0 + 1, n0 + 1 from refs0 where pos = 1 and way_id % 4 = 0),
nodes as (
  select distinct node_id, (l_partkey * 37) % 36000 - 18000 x, (l_suppkey * 53) % 18000 - 9000 y,
         ((l_partkey * 37) % 36000 - 18000)::double / 100.0::double lon, ((l_suppkey * 53) % 18000 - 9000)::double / 100.0::double lat
  from refs0),
ways as (
  select way_id osmid, o_orderstatus status, case when way_id % 11 <> 0 then o_orderpriority end priority, p_type kind,
         way_id % 7 version, o_orderdate ts, o_custkey changeset
  from refs0 join orders on o_orderkey = way_id left join part on p_partkey = l_partkey where pos = 1),
member as (
  select o_custkey osmid, row_number() over (partition by o_custkey order by o_orderkey) - 1 pos, o_orderkey memid,
         case when o_orderkey % 3 = 0 then 'inner' else 'outer' end role
  from orders),
rel as (
  select c_custkey osmid, case c_mktsegment when 'AUTOMOBILE' then 'multipolygon' when 'BUILDING' then 'boundary' when 'MACHINERY' then 'route'
         else lower(c_mktsegment) end kind
  from customer where c_custkey in (select o_custkey from orders)),
placed as (select way_id, pos, n, node_id, x, y, lon, lat from refs join nodes using (node_id))
"""
_WAY = "select osmid, 1::int osmtype, status, priority, kind from ways where "
_FLAT_WAY = "concat_ws(';', 'kind=' || kind, 'priority=' || priority, 'status=' || status)"
#: Rings in the order of the members: a state machine over lists, one step for each way taken or ring closed.
_AREAS = """,
wl as (select way_id, list(node_id order by pos) refs from refs group by way_id having count(*) >= 2),
mem as (select osmid, role = 'inner' is_inner, list(refs order by pos) ways from member join rel using (osmid) join wl on way_id = memid
        where kind in ('multipolygon', 'boundary') group by all),
walk as (
  select osmid, is_inner, ways, []::bigint[] used, []::bigint[] ring, []::bigint[][] done from mem
  union all
  select osmid, is_inner, ways,
         case when nxt is not null then list_append(used, abs(nxt)) else used end,
         case when nxt is null then []::bigint[] when nxt > 0 then ring || ways[nxt][least(len(ring), 1) + 1:] else ring || list_reverse(ways[-nxt])[2:] end,
         case when nxt is null then list_append(done, case when ring[1] = ring[-1] then ring else list_append(ring, ring[1]) end) else done end
  from (select *, case when len(ring) = 0 then free[1]
                       when ring[1] <> ring[-1] then coalesce(list_filter(free, lambda i: ways[i][1] = ring[-1])[1], -list_filter(free, lambda i: ways[i][-1] = ring[-1])[1]) end nxt
        from (select *, list_filter(range(1, len(ways) + 1), lambda i: not list_contains(used, i)) free from walk where len(used) < len(ways) or len(ring) > 0))),
closed as (select osmid, is_inner, unnest(range(1, len(done) + 1)) k, unnest(done) refs from walk where len(used) = len(ways) and len(ring) = 0),
big as (select *, count(*) filter (is_inner) over w > 1 and count(*) filter (not is_inner) over w > 1 complex from closed where len(refs) >= 4 window w as (partition by osmid)),
ringed as (select osmid, is_inner, k, unnest(range(1, len(refs) + 1)) pos, unnest(refs) node_id from big where not complex or not is_inner),
pts as (select osmid, is_inner, k, pos, lon, lat, lead(lon) over w lon2, lead(lat) over w lat2 from ringed join nodes using (node_id) window w as (partition by osmid, is_inner, k order by pos)),
text as (select osmid, is_inner, k, '(' || string_agg(lon::varchar || ' ' || lat::varchar, ', ' order by pos) || ')' t, min_by(lon, pos) x, min_by(lat, pos) y from pts group by all),
hits as (select i.osmid, i.k, o.k ok, count(*) filter (lon2 is not null and (o.lat > y) <> (lat2 > y) and x < (lon2 - lon) * (y - o.lat) / nullif(lat2 - o.lat, 0) + lon) n
         from text i join pts o on o.osmid = i.osmid and i.is_inner and not o.is_inner group by all),
single as (select osmid, count(*) filter (not is_inner) outers from text group by osmid),
held as (select i.osmid, i.k, min(h.ok) ok from text i join hits h on h.osmid = i.osmid and h.k = i.k join single s on s.osmid = i.osmid
         where i.is_inner and (s.outers = 1 or h.n % 2 = 1) group by all),
poly as (select o.osmid, o.k, '(' || o.t || coalesce((select string_agg(', ' || i.t, '' order by i.k) from text i join held h on h.osmid = i.osmid and h.k = i.k where i.is_inner and h.osmid = o.osmid and h.ok = o.k), '') || ')' t
         from text o where not o.is_inner),
area as (select osmid, case when count(*) > 1 then 'MULTIPOLYGON (' || string_agg(t, ', ' order by k) || ')' else 'POLYGON ' || min(t) end geometry from poly group by osmid)
select 2::int osmtype, rel.osmid, kind as "type", geometry, case when geometry is not null then 0::bigint end missing_refs from rel left join area on area.osmid = rel.osmid where kind in ('multipolygon', 'boundary')
"""
_CUTS = """,
used as (select *, count(*) over (partition by node_id) u from {refs} where n >= 2),
bound as (select way_id, node_id, pos from used where pos = 1 or pos = n or u > 1),
seg as (select way_id, node_id source, lead(node_id) over w target, lead(pos) over w - pos + 1 npts, row_number() over w - 1 seg
        from bound window w as (partition by way_id order by pos))
"""
_SHAPE = """,
ends as (select way_id, max(n) n, min_by(node_id, pos) = max_by(node_id, pos) closed from refs group by way_id),
code as (select osmid, case when n < 2 then 0 when n < 4 or not closed then 2 when kind in ('PROMO', 'MEDIUM', 'ECONOMY') then 3 else 2 end geom, n
         from ways join ends on way_id = osmid)
"""
_RING = "ring as (select osmid, role, memid ring, count(*) filter (role = 'inner') over w > 1 and count(*) filter (role = 'outer') over w > 1 complex from member join rel using (osmid) window w as (partition by osmid))"

_PLACES = ", one as (select n_name name, 'one/' || n_name url, 'one' provider from nation where n_regionkey < 3), two as (select n_name name from nation union all select r_name from region), place as (select * from one union all select distinct name, 'two/' || name || '.osm.pbf', 'two' from two where name not in (select name from one)) "

_BODIES = {
    "q01_must_tags": _WAY + "priority is not null",
    "q02_keep_pairs": _WAY + "status in ('O', 'P')",
    "q03_keep_any": _WAY + "priority is not null",
    "q04_keep_first_true": _WAY + "status in ('O', 'P') and not coalesce(priority = '1-URGENT', false) and not coalesce(kind = 'PROMO', false)",
    "q05_keep_first_false": _WAY + "status <> 'F' or coalesce(kind = 'PROMO', false)",
    "q06_tag_columns": "select osmid, 1::int osmtype, status, priority, null::varchar absent from ways",
    "q07_tags_long": "select key, value, count(*) n from (select 'status' key, status value from ways union all select 'priority', priority from ways union all select 'kind', kind from ways) where value is not null group by all",
    "q08_id_whitelist": _WAY + "osmid in (select c_custkey from customer)",
    "q09_geometry_points": "select node_id id, lon, lat from nodes",
    "q10_way_bbox": "select way_id osmid, min(lon) min_lon, max(lon) max_lon, min(lat) min_lat, max(lat) max_lat, count(*) n from placed group by way_id",
    "q11_way_length": ", step as (select way_id, x - lag(x) over w dx, y - lag(y) over w dy from placed where n >= 2 window w as (partition by way_id order by pos)) select way_id osmid, sum(dx * dx + dy * dy)::bigint length2 from step group by way_id",
    "q12_end_values": 'select way_id osmid, min_by(node_id, pos) "first", max_by(node_id, pos) "last" from refs group by way_id',
    "q13_topology_segments": _CUTS.format(refs="refs") + "select way_id osmid, seg, source, target, npts from seg where target is not null",
    "q14_topology_tags": ", mine as (select refs.* from refs join ways on osmid = way_id where status in ('O', 'P'))" + _CUTS.format(refs="mine") + "select osmid, seg, source, target, status, npts from seg join ways on osmid = way_id where target is not null",
    "q15_shared_nodes": "select node_id node, count(*) uses from refs where n >= 2 group by node_id having count(*) > 1",
    "q16_way_geotype": _SHAPE + "select osmid, geom::int geom from code",
    "q17_closed_area": _SHAPE + ", step as (select way_id, x, y, lead(x) over w x2, lead(y) over w y2 from placed window w as (partition by way_id order by pos)) select way_id osmid, abs(sum(x * y2 - x2 * y))::bigint area2 from step join ends using (way_id) where n >= 4 and closed group by way_id",
    "q18_relation_members": "select osmid, pos, memid, 1::int type, role from member join rel using (osmid)",
    "q19_relation_geotype": "select osmid, case when kind = 'route' then 2 when kind in ('multipolygon', 'boundary') then 3 else 0 end::int geom from rel",
    "q20_member_antijoin": "select osmid from ways where osmid not in (select memid from member join rel using (osmid) where kind = 'multipolygon')",
    "q21_ring_counts": "," + _RING + " select osmid, count(*) filter (role = 'outer') n_outer, count(*) filter (role = 'inner') n_inner from ring where not complex or role = 'outer' group by osmid",
    "q22_multi_split": ", line as (select member.osmid, memid from member join rel using (osmid) where kind = 'route' and memid in (select way_id from refs where n >= 2)) select osmid, case when count(*) > 1 then 'MULTILINESTRING' else 'LINESTRING' end kind, count(*) n from line group by osmid",
    "q23_polygon_index": "select osmid, memid ring, (sum((role = 'outer')::int) over (partition by osmid order by role <> 'outer', memid rows unbounded preceding) - 1)::bigint poly from member join rel using (osmid)",
    "q24_metadata": "select osmid, version, strftime(ts, '%Y-%m-%d %H:%M:%S') edited, changeset from ways",
    "q25_info": "select 'nodes' kind, count(*) elements, count(*) filter (node_id // 100000 in (select p_partkey from part)) tagged from nodes union all select 'ways', count(*), count(*) from ways union all select 'relations', count(*), count(*) from rel",
    "q26_expand_json": "select event_id, (props ->> '$.k')::bigint k from events",
    "q27_first_wins_union": ", c as (select n_name name, 'a/' || n_name url, 1 o from nation where n_nationkey in (select s_nationkey from supplier) union all select n_name, 'b/' || n_name, 2 from nation union all select r_name, 'c/' || r_name, 3 from region) select name, min_by(url, o) url from c group by name",
    "q28_comparable_string": "select p_partkey, replace(replace(upper('o''' || p_name || '’s'), '''', ''), '’', '') name from part",
    "q29_default_query": ", h as (select osmid, case kind when 'PROMO' then 'primary' when 'STANDARD' then 'corridor' when 'MEDIUM' then 'residential' when 'LARGE' then 'service' end highway, case when kind = 'LARGE' and osmid % 2 = 0 then 'yard' end service from ways) select osmid, highway, service, null::varchar oneway from h where highway is not null and highway not in ('corridor', 'residential') and service is null",
    "q30_elements_union": "select 0::int osmtype, count(*) n, sum(node_id)::bigint id_sum from nodes union all select 1, count(*), sum(osmid)::bigint from ways union all select 2, count(*), sum(osmid)::bigint from rel",
    "q31_way_wkt": _SHAPE + ", drawn as (select way_id, string_agg(lon::varchar || ' ' || lat::varchar, ', ' order by pos) w from placed group by way_id) select osmid, case geom when 3 then 'POLYGON ((' || w || '))' else 'LINESTRING (' || w || ')' end wkt, 0::bigint missing_refs from code join drawn on way_id = osmid where geom > 0",
    "q32_tags_wide": "select osmid, kind, priority, status from ways",
    "q33_coords": "select p_partkey * 100000 + p_partkey % 100 id, lon, lat from part left join nodes on node_id = p_partkey * 100000 + p_partkey % 100",
    "q34_strings": ", part_of as (select p_brand b, p_type t, p_size s from part where p_partkey in (select l_partkey from lineitem)) select distinct string from (select unnest(['status', 'kind', 'brand', 'ptype', 'size', 'type']) string union all select 'priority' from ways where priority is not null union all select status from ways union all select priority from ways union all select kind from ways union all select b from part_of union all select t from part_of union all select s::varchar from part_of union all select kind from rel union all select role from member join rel using (osmid)) where string is not null",
    "q35_json_rows": "select event_id, (props ->> '$.k')::bigint props from events where (props ->> '$.k') is not null",
    "q36_relation_areas": _AREAS,
    "q37_extract_nodes": "select node_id id, lon, lat, coalesce('brand=' || p_brand || ';ptype=' || p_type || ';size=' || p_size, '') tags, null::int version, null::bigint changeset from nodes left join part on p_partkey = node_id // 100000",
    "q38_extract_ways": f", r as (select way_id, string_agg(node_id::varchar, ',' order by pos) refs from refs group by way_id) select osmid id, refs, {_FLAT_WAY} tags, version, strftime(ts, '%Y-%m-%d %H:%M:%S') edited, changeset from ways join r on way_id = osmid",
    "q39_extract_relations": "select osmid id, 'type=' || kind tags, pos, memid ref, 1::int as \"type\", role from member join rel using (osmid)",
    "q40_extract_info": "select 'nodes' kind, count(*) elements, count(*) filter (node_id // 100000 in (select p_partkey from part)) tagged, true has_blocks from nodes union all select 'ways', count(*), count(*), true from ways union all select 'relations', count(*), count(*), true from rel",
    "q41_extract_features": "select * from (values ('required', 'OsmSchema-V0.6'), ('required', 'DenseNodes'), ('optional', 'Has_Metadata')) t(kind, feature)",
    "q42_extract_topology": ", mine as (select refs.* from refs join ways on osmid = way_id where status in ('O', 'P'))" + _CUTS.format(refs="mine") + "select osmid, seg, source, target, status, null::varchar tag_source, npts from seg join ways on osmid = way_id where target is not null",
    "q43_place_catalogue": _PLACES + "select name, url, 1::bigint urls, provider from place",
    "q44_place_files": _PLACES + "select name, replace(name, ' ', '_') || '.osm.pbf' file, 'content of ' || url content from place",
    "q45_relation_rows": "select osmid, pos, memid, 1::int as \"type\", role, case kind when 'route' then 2 else 3 end::int geom, kind tag_type from member join rel using (osmid) where kind in ('route', 'boundary')",
    "q46_point_geometry": "select node_id osmid, p_brand brand, 'SRID=4326;POINT (' || lon::varchar || ' ' || lat::varchar || ')' geometry, 0::bigint missing_refs from nodes join part on p_partkey = node_id // 100000 where p_brand is not null and coalesce(p_size not in (1, 2, 3), true)",
}
SQL = {name: (_VIEW.replace("with", "with recursive", 1) if body is _AREAS else _VIEW) + body for name, body in _BODIES.items()}
