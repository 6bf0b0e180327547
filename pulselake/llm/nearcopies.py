"""The pipeline's near copies: groups by five-word shingles, of which one document stays.

Round 0 takes its candidates from SimHash fingerprints linked by pigeonring chains, as op2 has them. At a
similarity of 0.8 fingerprints are up to 11 bits apart, so that these links alone would lose groups: bands
of registers find the rest (``hyperminhash.near_groups``). Either way whole shingle sets decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm import hyperminhash, simhash
from pulselake.llm.common import drop_path, write_table

WIDTH = 5
#: Links of a fingerprint to smaller ones that become candidates; in a crowd the rest is left to the next rounds.
NEIGHBOURS = 4


def fingerprint_pairs(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Candidates (a, b) among classes (fp, print): of one fingerprint, each with the least; of fingerprints
    that link, the least of each, with ``NEIGHBOURS`` smaller ones at most. So pairs grow with a group's
    members, not with their square."""
    centres, _ = write_table(classes.groupBy("print").agg(F.min("fp").alias("centre")), "centres")
    links = simhash.link_fingerprints(centres.select(F.col("print").alias("fp")), max_bits)
    links = links.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("a"))).where(F.col("n") <= NEIGHBOURS).drop("n")
    links, path = write_table(links, "fingerprint-links")
    same = classes.join(centres, "print").where("fp <> centre").select(F.col("centre").alias("a"), F.col("fp").alias("b"))
    linked = links.join(centres.toDF("a", "x"), "a").join(centres.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out, _ = write_table(same.union(linked), "fingerprint-pairs")
    drop_path(classes.sparkSession, path)
    return out


def near_copies(docs: DataFrame, large_group: int = hyperminhash.LARGE) -> DataFrame:
    """doc_id, text_hash and root (a number of the group) of every document: see ``near_groups``, with
    its rules for nulls, empty and long texts, repeated rows, other columns and empty tables. Documents
    without words are one group."""
    found = hyperminhash.near_groups(docs, WIDTH, large_group, fingerprint=simhash.fingerprint, first=fingerprint_pairs)
    return found.select("doc_id", "text_hash", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all its columns, as ``simhash.keep_one``."""
    return simhash.first_of_each(docs, near_copies(docs))
