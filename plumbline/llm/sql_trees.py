"""DuckDB SQL for the manifest and the vector codes, whose levels and rounds are written out one by one."""

from __future__ import annotations

#: Levels of parents that the SQL goes up: 16**5 leaves of a source and 16**3 sources at most.
LEAF_LEVELS, GROUP_LEVELS = 5, 3

CRC = """t as (select list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)) as crc)"""


def crc32(text: str) -> str:
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: cast('0x' || x as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295)"


def field(value: str) -> str:
    return f"coalesce(octet_length(encode(cast({value} as varchar))) || ':' || cast({value} as varchar), '-')"


def tree(name: str, levels: int) -> list[str]:
    """From {name}_0 (g, i, h) the parents p (g, i, hs, many) and the nodes above them, level by level."""
    out = []
    for k in range(levels):
        out.append(f"{name}_p{k} as (select *, sum(len(hs)) over (partition by g) > 1 as many from (select g, i // 16 as i, list(h order by i) as hs from {name}_{k} group by 1, 2) x)")
        out.append(f"{name}_{k + 1} as (select g, i, case when many then sha256(array_to_string(hs, '')) else hs[1] end as h from {name}_p{k})")
    return out


def walk(name: str, start: str, levels: int) -> list[str]:
    """From {start} (id, g, i, proof, folded) up the parents of a tree, collecting siblings and folding."""
    out, before = [], start
    for k in range(levels):
        rest = "w.i % 16"
        out.append(
            f"{name}_w{k} as (select id, w.g, w.i // 16 as i, "
            f"case when many then proof || array_to_string(hs[:{rest}] || hs[{rest} + 2:], '') else proof end as proof, "
            f"case when many then sha256(array_to_string(hs[:{rest}], '') || folded || array_to_string(hs[{rest} + 2:], '')) else folded end as folded "
            f"from {before} w join {name}_p{k} p on w.g = p.g and w.i // 16 = p.i)"
        )
        before = f"{name}_w{k}"
    return out


_FIELDS = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MANIFEST = "with " + ",\n".join([
    CRC,
    f"d as (select doc_id, coalesce('=' || source, '') as g, sha256({_FIELDS} || {field('text')}) as leaf, "
    f"case when {crc32('cast(doc_id as varchar)')} % 5 = 0 then sha256({_FIELDS} || {field(_LOWER)}) end as changed from documents, t)",
    "e as (select doc_id, g, leaf, coalesce(changed, leaf) as seen from d)",
    "n as (select *, row_number() over (order by g, doc_id) as id, row_number() over (partition by g order by doc_id nulls first, leaf, seen) - 1 as i from e)",
    "a_0 as (select g, i, leaf as h from n)",
    *tree("a", LEAF_LEVELS),
    f"b_0 as (select '' as g, row_number() over (order by g) - 1 as i, h, g as name from a_{LEAF_LEVELS})",
    *tree("b", GROUP_LEVELS),
    "a_w as (select id, g, i, '' as proof, seen as folded from n)",
    *walk("a", "a_w", LEAF_LEVELS),
    f"b_w as (select id, '' as g, b_0.i, proof, folded from a_w{LEAF_LEVELS - 1} w join b_0 on w.g = b_0.name)",
    *walk("b", "b_w", GROUP_LEVELS),
]) + (
    f"\nselect doc_id, leaf, b_0.h as subroot, r.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.h as verified"
    f"\nfrom n join b_w{GROUP_LEVELS - 1} w using (id) join b_0 on n.g = b_0.name, b_{GROUP_LEVELS} r"
)


def _nearest(name: str, book: str) -> str:
    """Each part with its nearest entry: distances are whole numbers, so one number holds distance and entry."""
    far = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)"
    return f"{name} as (select id, part, any_value(p.x) as x, min(cast({far} as hugeint) * 256 + entry) as m from p join {book} b using (part) group by id, part)"


def _codes(rounds: int = 4) -> str:
    parts = [
        "v as (select *, row_number() over (order by vec_id nulls last, embedding) as id from embeddings where embedding is not null "
        "and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        "w as (select id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e, len(embedding) // 4 as width from v)",
        "p as (select id, part, e[part * width + 1 : (part + 1) * width] as x from w, (select unnest(range(4)) as part) q)",
        "b0 as (select part, id - 1 as entry, x from p where id <= 256)",
    ]
    for k in range(rounds):
        parts += [
            _nearest(f"n{k}", f"b{k}"),
            f"u{k} as (select part, m % 256 as entry, unnest(range(len(x))) as i, unnest(x) as c from n{k})",
            f"s{k} as (select part, entry, list(mean order by i) as x from (select part, entry, i, floor(sum(c) / count(*)) as mean from u{k} group by 1, 2, 3) g group by 1, 2)",
            f"b{k + 1} as (select b.part, b.entry, coalesce(s.x, b.x) as x from b{k} b left join s{k} s on s.part = b.part and s.entry = b.entry)",
        ]
    parts += [
        _nearest("n", f"b{rounds}"),
        "c as (select id, string_agg(lpad(lower(to_hex(cast(m % 256 as bigint))), 2, '0'), '' order by part) as code, cast(sum(m // 256) as bigint) as error from n group by 1)",
        f"k as (select sha256(string_agg(array_to_string(list_transform(x, lambda y: cast(y as bigint)), ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds})",
    ]
    return "with " + ",\n".join(parts) + (
        "\nselect vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from w join c using (id), k"
    )


VECTOR_CODES = _codes()
