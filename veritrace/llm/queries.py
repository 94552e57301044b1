"""Registered queries of the training-data operators and their oracle SQL."""

from . import fingerprint, lattice, licences, mixing, packing, severity, simhash, simple8b, topk, warc

QUERIES = {
    "op10_severity": severity.op10_severity,
    "op1_topk": topk.op1_topk,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_simple8b": simple8b.op3_simple8b,
    "op4_mixing": mixing.op4_mixing,
    "op5_lattice": lattice.op5_lattice,
    "op6_packing": packing.op6_packing,
    "op7_warc": warc.op7_warc,
    "op8_licences": licences.op8_licences,
    "op9_simhash": simhash.op9_simhash,
}
ORACLE_SQL = {
    "op1_topk": topk.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_licences": licences.oracle(),
}
