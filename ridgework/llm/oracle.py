"""The queries that SQL can express, as SQL over the same tables."""

from __future__ import annotations

# Base 32 digit i of a SHA-1: five bits of its hex digits, ten of which hold eight digits.
WARC_CAPTURES = """
with hashed as (
    select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) h from pages
), digested as (
    select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, cast(1 + 10 * (i // 8) as int), 10))::bigint >> cast(35 - 5 * (i % 8) as int)) & 31)::int, 1
    )), '') payload_digest
    from hashed
), ranked as (
    select *, max(page_id) over (partition by payload_digest) first_id from digested
)
select page_id, cast(payload_bytes as bigint) payload_bytes, payload_digest,
       case when first_id is null or page_id = first_id then 'response' else 'revisit' end record_type,
       case when page_id is distinct from first_id then first_id end refers_to
from ranked
"""

# Every pair that shares a shingle, its resemblance, and the closure of the links.
ODD_SKETCHES = r"""
with recursive worded as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), held as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end s
    from worded
), shingles as (
    select doc_id, len(s) n, unnest(s) h from held
), links as (
    select a.doc_id a, b.doc_id b from shingles a join shingles b on a.h = b.h and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(doc_id, far) as (
    select doc_id, doc_id from held
    union
    select reach.doc_id, links.b from reach join links on reach.far = links.a
), heads as (
    select doc_id, min(far) component_id from reach group by doc_id
)
select held.doc_id, cast(len(s) as bigint) n_shingles, component_id, held.doc_id = component_id kept
from held join heads using (doc_id)
"""

# crc32 of the decimal id, bit by bit; a prefix is the list of its turns' hashes.
PREFIX_NODES = r"""
with turns as (
    select conv_id, md5(length(r) || ':' || r || t) code, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) words, turn
    from (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations where conv_id is not null)
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, code) place from turns
), convs as (
    select conv_id, conv_id - conv_id % 20 base, xor(4294967295, list_reduce(list_concat([4294967295],
        list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
            lambda v, k: xor(v // 2, 3988292384 * (v % 2))))) % 4 h
    from (select distinct conv_id from placed)
), heads as (
    select convs.conv_id, convs.h, place depth, code, words from convs join placed on placed.conv_id = base and place <= h
), taken as (
    select conv_id, count(*) head from heads group by conv_id
), steps as (
    select conv_id, depth, code, words from heads
    union all
    select convs.conv_id, coalesce(head, 0) + place - h, code, words
    from convs join placed using (conv_id) left join taken using (conv_id) where place > h
), rebuilt as (
    select convs.conv_id, list(code order by depth) filter (code is not null) codes, max(coalesce(depth, 0)) size
    from convs left join steps using (conv_id) group by convs.conv_id
), members as (
    select conv_id, size, depth, coalesce(array_to_string(list_slice(codes, 1, depth), ','), '') path,
           case when depth > 0 then coalesce(array_to_string(list_slice(codes, 1, depth - 1), ','), '') end above
    from rebuilt, unnest(range(size + 1)) u(depth)
), nodes as (
    select path, above, depth, min(conv_id) conv_id, count(*) n_convs,
           sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (size = depth), '')) ends_sha256
    from members group by path, above, depth
), sized as (
    select nodes.*, coalesce(words, 0) words, (select count(*) from nodes c where c.above = nodes.path) n_children
    from nodes left join steps on steps.conv_id = nodes.conv_id and steps.depth = nodes.depth
), sums as (
    select up.path, count(*) filter (n_children = 0) n_leaves, sum((n_convs - 1) * words) saved_tokens
    from sized join members up on up.conv_id = sized.conv_id and up.depth <= sized.depth group by up.path
)
select sized.conv_id, cast(sized.depth as bigint) depth, p.conv_id parent_conv_id, sized.n_convs, sized.n_children, n_leaves,
       cast(saved_tokens as bigint) saved_tokens, sized.ends_sha256
from sized join sums using (path) left join nodes p on p.path = sized.above
"""


def oracle() -> dict[str, str]:
    return {"op7_warc_captures": WARC_CAPTURES, "op12_odd_sketches": ODD_SKETCHES, "op13_prefix_trie": PREFIX_NODES}
