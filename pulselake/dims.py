"""Small fixed tables: annotation labels and classes, storage formats. Each is safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# label_store, symbol, short name, description of the standard annotation labels.
ANN_LABELS = [
    (0, " ", "NOTANN", "Not an actual annotation"),
    (1, "N", "NORMAL", "Normal beat"),
    (2, "L", "LBBB", "Left bundle branch block beat"),
    (3, "R", "RBBB", "Right bundle branch block beat"),
    (4, "a", "ABERR", "Aberrated atrial premature beat"),
    (5, "V", "PVC", "Premature ventricular contraction"),
    (6, "F", "FUSION", "Fusion of ventricular and normal beat"),
    (7, "J", "NPC", "Nodal (junctional) premature beat"),
    (8, "A", "APC", "Atrial premature contraction"),
    (9, "S", "SVPB", "Premature or ectopic supraventricular beat"),
    (10, "E", "VESC", "Ventricular escape beat"),
    (11, "j", "NESC", "Nodal (junctional) escape beat"),
    (12, "/", "PACE", "Paced beat"),
    (13, "Q", "UNKNOWN", "Unclassifiable beat"),
    (14, "~", "NOISE", "Signal quality change"),
    (16, "|", "ARFCT", "Isolated QRS-like artifact"),
    (18, "s", "STCH", "ST change"),
    (19, "T", "TCH", "T-wave change"),
    (20, "*", "SYSTOLE", "Systole"),
    (21, "D", "DIASTOLE", "Diastole"),
    (22, '"', "NOTE", "Comment annotation"),
    (23, "=", "MEASURE", "Measurement annotation"),
    (24, "p", "PWAVE", "P-wave peak"),
    (25, "B", "BBB", "Left or right bundle branch block"),
    (26, "^", "PACESP", "Non-conducted pacer spike"),
    (27, "t", "TWAVE", "T-wave peak"),
    (28, "+", "RHYTHM", "Rhythm change"),
    (29, "u", "UWAVE", "U-wave peak"),
    (30, "?", "LEARN", "Learning"),
    (31, "!", "FLWAV", "Ventricular flutter wave"),
    (32, "[", "VFON", "Start of ventricular flutter/fibrillation"),
    (33, "]", "VFOFF", "End of ventricular flutter/fibrillation"),
    (34, "e", "AESC", "Atrial escape beat"),
    (35, "n", "SVESC", "Supraventricular escape beat"),
    (36, "@", "LINK", "Link to external data (aux_note contains URL)"),
    (37, "x", "NAPC", "Non-conducted P-wave (blocked APB)"),
    (38, "f", "PFUS", "Fusion of paced and normal beat"),
    (39, "(", "WFON", "Waveform onset"),
    (40, ")", "WFOFF", "Waveform end"),
    (41, "r", "RONT", "R-on-T premature ventricular contraction"),
]

# Labels that mark a QRS complex.
QRS_LABELS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 25, 30, 31, 34, 35, 38, 41]

# Extension, description, human reviewed.
ANN_CLASSES = [
    ("atr", "Reference ECG annotations", True),
    ("blh", "Human reviewed beat labels", True),
    ("blm", "Machine beat labels", False),
    ("alh", "Human reviewed alarms", True),
    ("alm", "Machine alarms", False),
    ("qrsc", "Human reviewed QRS detections", True),
    ("qrs", "Machine QRS detections", False),
    ("bph", "Human reviewed BP beat detections", True),
    ("bpm", "Machine BP beat detections", False),
]

# Format, bits, bytes a sample, smallest and largest sample, value of a missing sample.
DAT_FORMATS = [
    ("8", 8, 1.0, -(2**31), 2**31 - 1, None),
    ("16", 16, 2.0, -32768, 32767, -32768),
    ("24", 24, 3.0, -(2**23), 2**23 - 1, -(2**23)),
    ("32", 32, 4.0, -(2**31), 2**31 - 1, -(2**31)),
    ("61", 16, 2.0, -32768, 32767, -32768),
    ("80", 8, 1.0, -128, 127, -128),
    ("160", 16, 2.0, -32768, 32767, -32768),
    ("212", 12, 1.5, -2048, 2047, -2048),
    ("310", 10, 4 / 3, -512, 511, -512),
    ("311", 10, 4 / 3, -512, 511, -512),
]


def ann_labels(spark: SparkSession) -> DataFrame:
    """label_store, symbol, short_description, description, is_qrs: a row a standard label."""
    rows = [(*r, r[0] in QRS_LABELS) for r in ANN_LABELS]
    return spark.createDataFrame(rows, "label_store int, symbol string, short_description string, description string, is_qrs boolean")


def ann_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANN_CLASSES, "extension string, description string, human_reviewed boolean")


def dat_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DAT_FORMATS, "fmt string, bits int, bytes_per_sample double, min_value long, max_value long, invalid long")


def sql_values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list."""

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"
