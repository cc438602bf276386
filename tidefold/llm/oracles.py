"""DuckDB SQL for the operators that SQL can express."""

import string

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
with k as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
d as (select doc_id, lines, list_transform(lines, lambda x: translate(trim(x, {_SPACES}), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) as keys from k),
frequent as (select coalesce(list(key), []) as f from (select key from (select distinct doc_id, unnest(keys) as key from d) where key <> '' group by key having count(*) >= 10)),
r as (select doc_id, lines, list_filter(lines, lambda x, i: not list_contains(f, keys[i])) as kept from d, frequent)
select doc_id, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped, sha256(array_to_string(kept, chr(10))) as kept_sha256 from r
"""

#: Weights 3, 1, 2 and the schedules that integrate to them: 4 to 2, 1, and 1 to 2 to 3.
MIXING = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
  md5(coalesce(doc_id::varchar, '')) as r, md5(coalesce(text, '')) as tie from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source is null, source) - 1) % 3 as class from d group by source),
w as (select *, case class when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, 2 * source_size as cap from s),
l as (select *, (1.5::double * (sum(source_size) over ())::bigint - coalesce(sum(cap) over before, 0)::bigint) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from w window before as (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding)),
t as (select *, least(cap::double, max(case when level * w <= cap then level end) over () * w) as target from l),
p as (select d.*, t.source_size, t.target, t.class, coalesce(sum(size) over (partition by d.source order by r, tie rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join t on t.source is not distinct from d.source),
m as (select *, 2 * before + size as first, 2 * (source_size + before) + size as second from p),
u as (select *, first / (2 * target) as u from m)
select doc_id, size, source_size, target, (size * ((first < 2 * target)::int + (second < 2 * target)::int))::bigint as taken,
  case when size > 0 and first < 2 * target then case class
    when 0 then (sqrt(greatest(16.0::double + -4.0::double * (u * 3.0::double), 0.0::double)) - 4.0::double) / -2.0::double
    when 1 then u
    else case when u * 2.0::double <= 0.75::double then (sqrt(greatest(1.0::double + 4.0::double * (u * 2.0::double), 0.0::double)) - 1.0::double) / 2.0::double
      else 0.5::double + (sqrt(greatest(4.0::double + 4.0::double * (u * 2.0::double - 0.75::double), 0.0::double)) - 2.0::double) / 2.0::double end end end as position
from u
"""

SHARDING = """
with c as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) x(i))),
d as (select doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) + 16 as size from documents),
h as (select doc_id, size, md5(text) as k, list_transform(range(size - 16), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint) as bytes from (select *, hex(encode(text)) as x from d)),
o as (select doc_id, size, k, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::bigint) as text_crc32,
  coalesce(sum(size) over (order by k, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start, sum(size) over ()::bigint as total from h, c),
s as (select *, ((2 * start + size) * 40 // (2 * total))::int as shard from o)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by k, doc_id) - 1 as slot, null::int as grown_shard from s
"""
