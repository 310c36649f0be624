"""The queries of this package, and SQL for those that SQL can express."""

from . import bpe, collocations, decontam, exactdedup, langid, linededup, minhash, pii, sharding, spelling, suffixdedup, token_files, topk

QUERIES = {
    f.__name__: f for f in (
        sharding.op1_sharding, token_files.op2_token_files, bpe.op3_bpe, decontam.op4_decontam,
        suffixdedup.op5_suffixdedup, minhash.op6_minhash, pii.op7_pii, langid.op8_langid, topk.op9_topk,
        linededup.op10_linededup, collocations.op11_collocations, spelling.op12_spelling, exactdedup.op13_exactdedup
    )
}
ORACLE_SQL = {"op9_topk": topk.SQL, "op10_linededup": linededup.SQL, "op11_collocations": collocations.SQL, "op12_spelling": spelling.SQL, "op13_exactdedup": exactdedup.SQL}
