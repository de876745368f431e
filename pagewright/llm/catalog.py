"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .jpeg import op5_progressive_jpeg
from .licenses import op2_license_scan
from .neighbours import op8_nn_descent
from .packing import op9_pack_ffd
from .quality import op7_quality
from .secrets import op10_secret_scan
from .sentencepieces import op3_sentencepiece
from .simhash import op1_simhash
from .toxicity import op6_toxicity
from .warc import op4_warc

QUERIES = {q.__name__: q for q in (op1_simhash, op2_license_scan, op3_sentencepiece, op4_warc, op5_progressive_jpeg, op6_toxicity, op7_quality, op8_nn_descent, op9_pack_ffd, op10_secret_scan)}
# Five hexadecimal digits of the SHA-1 are four digits of base 32.
_BASE32 = "array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * i + 1, 5))::int >> k) & 31) + 1, 1)), '')), '')"
ORACLE_SQL: dict[str, str] = {
    "op4_warc": f"""with p as (select page_id, coalesce(html, '') h from pages), d as (select page_id, strlen(h)::bigint n, sha1(h) x, max(page_id) over (partition by h) kept from p)
select page_id, n payload_bytes, {_BASE32} payload_digest, case when page_id is not distinct from kept then 'response' else 'revisit' end record_type, case when page_id is distinct from kept then kept end refers_to from d""",
}
