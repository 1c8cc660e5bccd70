"""Fixed tables of the log: which event types which socket may write in which mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Event types by where they may be written - by the standard socket, which works in normal
# mode alone, or by the admin socket in normal mode ("admin") and in each other mode named.
ADMITTED = (
    (
        ("standard", "admin"),
        "write_event observation_read observation_write MEMORY_PROMOTED MEMORY_RETIRED PROCEDURE_PUBLISHED PROCEDURE_RETIRED COHORT_SPLIT"
        " TOPIC_VERIFIED TOPIC_CURATED TOPIC_BULLETS_RETIRED TOPIC_METADATA_SET TOPIC_SUGGESTED TOPIC_SUGGESTION_ACCEPTED TOPIC_SUGGESTION_DISMISSED",
    ),
    (("admin",), "ACL_SEALED"),
    (
        ("admin", "install_freeze", "recovery"),
        "PRINCIPAL_DECLARED PRINCIPAL_RENAME PRINCIPAL_TOMBSTONE PRINCIPAL_UID_BOUND PRINCIPAL_UID_UNBOUND PRINCIPAL_KEY_BOUND PRINCIPAL_KEY_UNBOUND"
        " PRINCIPAL_ACCESS_ENABLED PRINCIPAL_ACCESS_DISABLED FEATURE_PROPOSED FEATURE_ACTIVE FEATURE_ROLLED_BACK FEATURE_INSTALL_FAILED"
        " BROKER_KEY_ROTATED REGISTER_EVENT_TYPE",
    ),
    (
        ("admin", "install_freeze"),
        "INSTALL_STARTED INSTALL_STEP_COMPLETED INSTALL_STEP_HEARTBEAT INSTALL_STEP_FORCE_RESUME INSTALL_COMPLETED INSTALL_ABORTED INSTALL_TIMEOUT"
        " INSTALL_ROLLED_BACK TAG_SCHEMA_PROPOSED TAG_SCHEMA_ACTIVE",
    ),
    (("admin", "read_only"), "RECOVERY_MODE_ENTERED"),
    (("admin", "recovery"), "RECOVERY_MODE_EXITED"),
    (("recovery",), "RECOVERY_ACCEPTED RECOVERY_REPUDIATED"),
)
MODES = ("normal", "install_freeze", "read_only", "recovery")


def matrix(spark: SparkSession) -> DataFrame:
    """(type, socket, mode, admissible) of every registered type."""
    rows = []
    for allowed, kinds in ADMITTED:
        for kind in kinds.split():
            for mode in MODES:
                rows.append((kind, "standard", mode, mode == "normal" and "standard" in allowed))
                rows.append((kind, "admin", mode, ("admin" if mode == "normal" else mode) in allowed))
    return spark.createDataFrame(rows, "type string, socket string, mode string, admissible boolean")
