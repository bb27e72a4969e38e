"""The example composite as rows of the three template tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from driftline.plans.composite import BASES, PATCHES, STEPS, Templates

NAME = "hash-pipeline"

# The example composite, six resources in the order of its template.
GROUP = "status.pipeline.processGroupId"
GENERATE = "status.pipeline.generateFlowFileId"
HASH = "status.pipeline.replaceTextId"
LOG = "status.pipeline.logAttributeId"
OUTPUTS = [GROUP, GENERATE, HASH, LOG]
KINDS = [
    ("process-group", "ProcessGroup", GROUP),
    ("generate-flowfile", "Processor", GENERATE),
    ("replace-text", "Processor", HASH),
    ("log-attribute", "Processor", LOG),
    ("conn-generate-to-replace", "Connection", None),
    ("conn-replace-to-log", "Connection", None),
]
NAMESPACE = 'metadata.labels["claim-namespace"]', "metadata.namespace", False
CONFIG = "spec.providerConfigRefName", "spec.providerConfigRef.name", False
CONFIG_BASE = {"spec.providerConfigRef.name": "default", "spec.providerConfigRef.kind": "ProviderConfig"}
PARENT = GROUP, "spec.forProvider.parentGroupId", True
FIELDS = {
    "process-group": {"position.x": "0", "position.y": "0", "desiredState": "RUNNING"},
    "generate-flowfile": {
        "type": "GenerateFlowFile", "name": "Generate FlowFile", "position.x": "400", "position.y": "100",
        "config.schedulingStrategy": "TIMER_DRIVEN", "config.schedulingPeriod": "5 sec",
        "config.concurrentlySchedulableTaskCount": "1", "config.properties.File Size": "1 KB",
        "config.properties.Batch Size": "1", "config.comments": "Generates test flow files", "desiredState": "STOPPED",
    },
    "replace-text": {
        "type": "HashContent", "name": "Hash Content SHA-256", "position.x": "400", "position.y": "400",
        "config.properties.Hash Attribute": "content.hash", "config.properties.Hash Algorithm": "SHA-256",
        "config.autoTerminatedRelationships": "failure", "config.comments": "Hashes flow file content with SHA-256",
        "desiredState": "STOPPED",
    },
    "log-attribute": {
        "type": "LogAttribute", "name": "Log Content Hash", "position.x": "400", "position.y": "700",
        "config.properties.Log Level": "info", "config.properties.Log Payload": "true",
        "config.autoTerminatedRelationships": "success", "config.comments": "Logs the SHA-256 content hash",
        "desiredState": "STOPPED",
    },
    "conn-generate-to-replace": {
        "name": "GenerateFlowFile to ReplaceText", "selectedRelationships": "success", "source.type": "PROCESSOR",
        "destination.type": "PROCESSOR", "backPressureObjectThreshold": "10000", "backPressureDataSizeThreshold": "1 GB",
    },
    "conn-replace-to-log": {
        "name": "ReplaceText to LogAttribute", "selectedRelationships": "success", "source.type": "PROCESSOR",
        "destination.type": "PROCESSOR", "backPressureObjectThreshold": "10000", "backPressureDataSizeThreshold": "1 GB",
    },
}
ENDS = {"conn-generate-to-replace": (GENERATE, HASH), "conn-replace-to-log": (HASH, LOG)}


def patches(step: str) -> list[tuple[str, str, bool]]:
    """(source, target, required) of a step."""
    if step == "process-group":
        return [NAMESPACE, ("spec.parentGroupId", "spec.forProvider.parentGroupId", False), CONFIG]
    if step not in ENDS:
        return [NAMESPACE, PARENT, CONFIG]
    groups = [(GROUP, f"spec.forProvider.{end}.groupId", True) for end in ("source", "destination")]
    ids = [(path, f"spec.forProvider.{end}.id", True) for end, path in zip(("source", "destination"), ENDS[step], strict=True)]
    return [NAMESPACE, PARENT, *groups, *ids, CONFIG]


def base(step: str) -> dict[str, str]:
    return {**{f"spec.forProvider.{k}": v for k, v in FIELDS[step].items()}, **CONFIG_BASE}


BASE_ROWS = [(step, path, value) for step, _, _ in KINDS for path, value in base(step).items()]
PATCH_ROWS = [(step, i, *p) for step, _, _ in KINDS for i, p in enumerate(patches(step))]


def templates(spark: SparkSession) -> Templates:
    return Templates(
        spark.createDataFrame([(NAME, step, i, kind, output) for i, (step, kind, output) in enumerate(KINDS)], STEPS),
        spark.createDataFrame([(NAME, *row) for row in PATCH_ROWS], PATCHES),
        spark.createDataFrame([(NAME, *row) for row in BASE_ROWS], BASES),
    )
