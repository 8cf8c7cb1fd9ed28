"""Queries of the ten training-data problems, over whole tables."""

from __future__ import annotations

from talasik.llm import canonical, consensus, encode, formdups, langid, mapping, names, packing, pii, scanrepair
from talasik.llm.sql import SQL
from talasik.session import table

__all__ = ["QUERIES", "SQL"]


def _t(s, d, *names):
    return [table(s, d, n) for n in names]


LABELS = ("scan_blotter", "encoder_label", "incident_type_ref")

QUERIES = {
    "p1_found": lambda s, d: names.found_pairs(table(s, d, "scan_blotter")),
    "p1_clusters": lambda s, d: names.clusters_of(table(s, d, "scan_blotter")),
    "p2_found": lambda s, d: mapping.found_entries(*_t(s, d, "scan_blotter", "place_ref", "status_ref")),
    "p5_found": lambda s, d: pii.found_details(table(s, d, "scan_blotter")),
    "p5_redacted": lambda s, d: pii.redacted(table(s, d, "scan_blotter")),
    "p7_found": lambda s, d: consensus.found_types(*_t(s, d, *LABELS)),
    "p7_reliability": lambda s, d: consensus.reliability(*_t(s, d, *LABELS)),
    "p7_alpha": lambda s, d: consensus.alpha(consensus.votes_of(*_t(s, d, *LABELS[:2]))),
    "p3_found": lambda s, d: langid.found_languages(*_t(s, d, "scan_blotter", "documents")),
    "p3_languages": lambda s, d: langid.languages(*_t(s, d, "scan_blotter", "documents")),
    "p6_found": lambda s, d: scanrepair.found_noise(*_t(s, d, "scan_blotter", "ocr_calibration")),
    "p6_repaired": lambda s, d: scanrepair.repaired(*_t(s, d, "scan_blotter", "ocr_calibration")),
    "p4_found": lambda s, d: formdups.found_copies(table(s, d, "scan_blotter")),
    "p4_collapsed": lambda s, d: formdups.collapsed(table(s, d, "scan_blotter")),
    "p8_ids": lambda s, d: encode.encode_corpus(table(s, d, "documents")),
    "p9_containers": lambda s, d: packing.containers_of_documents(table(s, d, "documents")),
    "p9_reduction": lambda s, d: packing.reduction_of_documents(table(s, d, "documents")),
    "p10_found": lambda s, d: canonical.found_kinds(table(s, d, "documents")),
    "p10_canonical": lambda s, d: canonical.canonical_forms(table(s, d, "documents")),
}
