"""DuckDB SQL for the rows of the corpus queries that SQL can express.

Neighbours (an approximate index), toxicity and quality (trained models), the mix (Newton steps and
rounding) and token counts have none; they are tested against brute force, exact counts or held-out rows.
"""

from __future__ import annotations

from plumbline.llm.sql_trees import MANIFEST, VECTOR_CODES

SPACE = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')"
LOWER_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    f"'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), lambda x: x <> '')"
)


def shingles(n: int) -> str:
    """The runs of n words of the list w; of a shorter list the whole."""
    return (
        f"case when len(w) >= {n} then list_transform(range(1, len(w) - {n - 2}), lambda k: array_to_string(w[k:k + {n - 1}], ' ')) "
        "when len(w) > 0 then [array_to_string(w, ' ')] else [] end"
    )


# The table of the checksum comes from its polynomial.
SHARDS = """
with t as (select list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)) as crc),
d as (select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint)) as b from documents),
c as (select doc_id, cast(size as bigint) as size, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) as text_crc32 from d, t),
p as (select *, 2 * sum(size) over (order by doc_id rows unbounded preceding) - size as twice, sum(size) over () as total from c),
s as (select *, cast(least(39, twice * 40 // (2 * total)) as integer) as shard from p)
select doc_id, size, cast(text_crc32 as bigint) as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id) - 1 as slot, cast(null as integer) as grown_shard from s
"""

NEAR_COPIES = f"""
with recursive w as (select doc_id, {LOWER_WORDS} as w from documents),
s as (select distinct doc_id, unnest({shingles(3)}) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on a = x.doc_id join n y on b = y.doc_id where 100 * common >= 90 * (x.n + y.n - common)),
reach(doc_id, low) as (select doc_id, doc_id from w union select b, low from reach join links on doc_id = a)
select w.doc_id, coalesce(n, 0) as n_shingles, component_id
from w left join n using (doc_id) join (select doc_id, min(low) as component_id from reach group by 1) r using (doc_id)
"""

UNIQUE_BYTES = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
i as (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from d),
win as (select doc_id, i, md5(substr(h, 2 * i + 1, 100)) as s from i),
late as (select doc_id, i from (select *, min(doc_id) over (partition by s) as first from win) x where doc_id > first),
runs as (select doc_id, min(i) as a, max(i) + 50 as z from (
  select doc_id, i, sum(case when i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as island
  from (select doc_id, i, coalesce(lag(i) over (partition by doc_id order by i), i) as before from late) l) m group by doc_id, island),
edges as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as since, lead(a) over (partition by doc_id order by a) as next from runs),
kept as (select e.doc_id, sum(z - a) as n, count(*) as spans,
  string_agg(substr(h, 2 * since + 1, 2 * (a - since)) || case when next is null then substr(h, 2 * z + 1) else '' end, '' order by a) as kept
  from edges e join d using (doc_id) group by 1)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
       sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join kept k using (doc_id)
"""

CONTAINED_ITEMS = f"""
with ds as (select distinct doc_id, unnest({shingles(5)}) as s from (select doc_id, {LOWER_WORDS} as w from documents) d),
items as (select distinct item_id, unnest({shingles(5)}) as s from (select item_id, {LOWER_WORDS} as w from benchmark) i),
n as (select item_id, count(*) as n_shingles from items group by 1)
select doc_id, item_id, n_shingles, count(*) as n_shared, count(*) / n_shingles as containment
from ds join items using (s) join n using (item_id)
group by doc_id, item_id, n_shingles having count(*) * 100 >= n_shingles * 80
"""

PASSAGES = f"""
with w as (select doc_id, {WORDS} as w from documents),
i as (select doc_id, w, unnest(range(1, len(w) - 33)) as i from w),
win as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as s from i),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as k from (select *, count(*) over (partition by s) as n from win) x where n > 1),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as k from w),
kept as (select w.doc_id, string_agg(x, ' ' order by w.k) as kept from words w left join gone g on w.doc_id = g.doc_id and w.k = g.k where g.k is null group by 1),
n as (select doc_id, count(*) as n from gone group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w d left join n using (doc_id) left join kept using (doc_id)
"""

LINES = """
        with l as (
          select doc_id, string_split(text, chr(10)) as lines from documents),
        p as (select doc_id, lines, unnest(range(1, len(lines))) as k from l),
        w as (select doc_id, k, row_number() over (partition by lines[k], lines[k + 1] order by doc_id, k) as n from p),
        gone as (select distinct doc_id, unnest([k, k + 1]) as k from w where n > 1),
        spans as (
          select doc_id, count(*) as n_removed, list(k) as ks, cast(count(*) filter (k <> coalesce(before, -1) + 1) as integer) as n_runs
          from (select doc_id, k, lag(k) over (partition by doc_id order by k) as before from gone) group by 1)
        select doc_id, cast(len(lines) as integer) as n_lines, cast(coalesce(n_removed, 0) as integer) as n_removed, coalesce(n_runs, 0) as n_runs,
               sha256(array_to_string(list_filter(lines, lambda x, j: not coalesce(list_contains(ks, j), false)), chr(10))) as kept_sha256
        from l left join spans using (doc_id)
        """

# Besides the runs of two lines, lines of twenty words and lines that are a whole text.
LINES_ALONE = """
        with l as (
          select doc_id, string_split(text, chr(10)) as lines from documents),
        p as (select doc_id, lines, unnest(range(1, len(lines) + 1)) as k from l),
        w as (
          select doc_id, k, row_number() over (partition by lines[k], lines[k + 1] order by doc_id, k) as n from p where k < len(lines)),
        o as (
          select doc_id, k, len(lines) as n_lines, len(regexp_extract_all(lines[k], '[^\\x20\\x09-\\x0D]+')) as words,
                 row_number() over (partition by lines[k] order by doc_id, k) as n from p),
        gone as (
          select doc_id, unnest([k, k + 1]) as k from w where n > 1
          union select doc_id, k from o where n > 1 and (words >= 20 or n_lines = 1 and words > 0)),
        spans as (
          select doc_id, count(*) as n_removed, list(k) as ks, cast(count(*) filter (k <> coalesce(before, -1) + 1) as integer) as n_runs
          from (select doc_id, k, lag(k) over (partition by doc_id order by k) as before from gone) group by 1)
        select doc_id, cast(len(lines) as integer) as n_lines, cast(coalesce(n_removed, 0) as integer) as n_removed, coalesce(n_runs, 0) as n_runs,
               sha256(array_to_string(list_filter(lines, lambda x, j: not coalesce(list_contains(ks, j), false)), chr(10))) as kept_sha256
        from l left join spans using (doc_id)
        """

ORACLES = {
    "op1_byte_shards": SHARDS,
    "op3_near_copies": NEAR_COPIES,
    "op5_unique_bytes": UNIQUE_BYTES,
    "op6_contained_items": CONTAINED_ITEMS,
    "op7_repeated_passages": PASSAGES,
    "op9_line_dedup": LINES,
    "op9_line_dedup_alone": LINES_ALONE,
    "op12_manifest": MANIFEST,
    "op13_vector_codes": VECTOR_CODES,
}
