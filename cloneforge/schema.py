"""Schemas of the tables that the operators exchange."""

from pyspark.sql import types as T


def _of(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_s, _i, _l, _d = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

#: Raw copy numbers by genomic bin, long.
BINS = _of(cell=_s, chrom=_s, pos=_l, cn=_i)
#: Raw relative copy numbers by gene, long.
GENES = _of(cell=_s, gene=_s, rel=_d)
#: Segmented profiles, long.
PROFILE = _of(cell=_s, chrom=_s, bin=_i, cn=_i)
#: One chromosome of one cell.
PACKED = _of(cell=_s, chrom=_s, cns=T.ArrayType(_i))
ANNOTATION = _of(gene=_s, chrom=_s, start=_l, end=_l)
BAND = _of(chrom=_s, start=_l, end=_l, band=_s)
PATHWAY = _of(chrom=_s, start=_l, end=_l, name=_s, pathway=_s)
EDGES = _of(src=_s, dst=_s, w=_l)
TREE = _of(parent=_s, child=_s, dist=_l)
COORDS = _of(cell=_s, x=_d, y=_d)
LINEAGE = _of(cell=_s, depth=_i, subtreesize=_l)
SCORES = _of(cell=_s, feature=_s, amp=_d, del_=_d)
RESULT = _of(region=_s, Score=_d, pvalue=_d, adjustp=_d, cell=_s, depth=_i, subtreesize=_l, CNA=_s)
PARALLEL = _of(region=_s, lineage=_l, pvalue=_d)
