"""Record schemas of the six resource kinds and of the configuration records.

``DESIRED`` is what a user declares, ``ENTITY`` what the remote system reports.
"""

from __future__ import annotations

POSITION = "STRUCT<x DOUBLE, y DOUBLE>"
ENDPOINT = "STRUCT<id STRING, type STRING, groupId STRING>"
PARAMETER = "STRUCT<name STRING, value STRING, description STRING, sensitive BOOLEAN>"
REVISION = "STRUCT<version BIGINT>"
PROPERTIES = "MAP<STRING, STRING>"

DESIRED = {
    "Processor": f"""
        parentGroupId STRING, type STRING, name STRING, position {POSITION},
        config STRUCT<properties {PROPERTIES}, autoTerminatedRelationships ARRAY<STRING>,
                      schedulingStrategy STRING, schedulingPeriod STRING,
                      concurrentlySchedulableTaskCount INT, penaltyDuration STRING,
                      yieldDuration STRING, bulletinLevel STRING, comments STRING>,
        desiredState STRING""",
    "Connection": f"""
        parentGroupId STRING, source {ENDPOINT}, destination {ENDPOINT},
        selectedRelationships ARRAY<STRING>, name STRING, flowFileExpiration STRING,
        backPressureObjectThreshold BIGINT, backPressureDataSizeThreshold STRING,
        bends ARRAY<{POSITION}>, labelIndex INT, prioritizers ARRAY<STRING>,
        loadBalanceStrategy STRING, loadBalancePartitionAttribute STRING,
        loadBalanceCompression STRING""",
    "ControllerService": f"""
        parentGroupId STRING, type STRING, name STRING, properties {PROPERTIES},
        comments STRING, desiredState STRING""",
    "ProcessGroup": f"""
        parentGroupId STRING, name STRING, position {POSITION}, comments STRING,
        parameterContextId STRING, desiredState STRING""",
    "ParameterContext": f"""
        name STRING, description STRING, parameters ARRAY<{PARAMETER}>,
        inheritedParameterContexts ARRAY<STRING>""",
    "RegistryFlow": f"""
        parentGroupId STRING, registryId STRING, bucketId STRING, flowId STRING,
        flowVersion INT, position {POSITION}, desiredState STRING""",
}

ENTITY = {
    "Processor": f"""
        id STRING, revision {REVISION}, status STRUCT<runStatus STRING>,
        component STRUCT<name STRING,
                         config STRUCT<properties {PROPERTIES}, schedulingStrategy STRING,
                                       schedulingPeriod STRING>,
                         validationStatus STRING, validationErrors ARRAY<STRING>>""",
    "Connection": f"""
        id STRING, revision {REVISION},
        component STRUCT<name STRING, flowFileExpiration STRING,
                         backPressureObjectThreshold BIGINT,
                         backPressureDataSizeThreshold STRING>""",
    "ControllerService": f"""
        id STRING, revision {REVISION},
        component STRUCT<name STRING, properties {PROPERTIES}, state STRING,
                         validationStatus STRING, validationErrors ARRAY<STRING>>""",
    "ProcessGroup": f"""
        id STRING, revision {REVISION}, component STRUCT<name STRING, comments STRING>,
        runningCount INT, stoppedCount INT, disabledCount INT, invalidCount INT""",
    "ParameterContext": f"""
        id STRING, revision {REVISION},
        component STRUCT<name STRING, description STRING,
                         parameters ARRAY<STRUCT<parameter: STRUCT<name STRING, value STRING,
                                                                   description STRING>>>,
                         boundProcessGroups ARRAY<STRUCT<id STRING>>>""",
    "RegistryFlow": f"""
        id STRING, revision {REVISION}, runningCount INT, stoppedCount INT,
        versionControlInformation STRUCT<version VARIANT, state STRING>""",
}

CONDITION = (
    "STRUCT<type STRING, status STRING, reason STRING, message STRING, "
    "lastTransitionTime TIMESTAMP, observedGeneration BIGINT>"
)

METADATA = (
    "STRUCT<name STRING, namespace STRING, uid STRING, generation BIGINT, "
    "creationTimestamp TIMESTAMP, deletionTimestamp TIMESTAMP, "
    "annotations MAP<STRING, STRING>, labels MAP<STRING, STRING>>"
)


#: What a resource's status says of the remote record, by kind.
STATUS = {
    "Processor": "id STRING, runStatus STRING, version BIGINT, validationStatus STRING, validationErrors ARRAY<STRING>",
    "Connection": "id STRING, version BIGINT",
    "ControllerService": "id STRING, state STRING, version BIGINT, validationStatus STRING, validationErrors ARRAY<STRING>",
    "ProcessGroup": "id STRING, runningCount INT, stoppedCount INT, disabledCount INT, invalidCount INT, version BIGINT",
    "ParameterContext": "id STRING, version BIGINT, boundProcessGroups ARRAY<STRING>",
    "RegistryFlow": "processGroupId STRING, currentVersion INT, latestVersion INT, stale BOOLEAN, version BIGINT",
}

SECRET = "STRUCT<name STRING, namespace STRING, key STRING>"
#: Where credentials are, by their source: a secret, an environment variable, a file.
SELECTORS = f"secretRef {SECRET}, env STRUCT<name STRING>, fs STRUCT<path STRING>"
REFERENCE = "STRUCT<kind STRING, name STRING>"
CONFIG_KINDS = ("ProviderConfig", "ClusterProviderConfig")
USAGE_KINDS = ("ProviderConfigUsage", "ClusterProviderConfigUsage")


#: The name that the config's version field has here; documents have their own.
VERSION_FIELD = "systemVersion"


def resource_schema(kind: str, version_field: str | None = None) -> str:
    """DDL of one whole document: a resource, a config or a usage record.

    A config must say under which name its documents state the system version.
    """
    head = f"apiVersion STRING, kind STRING, metadata {METADATA}"
    if kind in CONFIG_KINDS:
        if version_field is None:
            raise ValueError("the version field of a config has to be named")
        return f"""{head},
            spec STRUCT<credentials STRUCT<source STRING, {SELECTORS}>, {version_field} INT>,
            status STRUCT<users BIGINT>"""
    if kind in USAGE_KINDS:
        return f"""{head}, providerConfigRef {REFERENCE},
            resourceRef STRUCT<apiVersion STRING, kind STRING, name STRING, uid STRING>"""
    return f"""{head},
        spec STRUCT<forProvider STRUCT<{DESIRED[kind]}>,
                    managementPolicies ARRAY<STRING>,
                    providerConfigRef {REFERENCE}>,
        status STRUCT<atProvider STRUCT<{STATUS[kind]}>, conditions ARRAY<{CONDITION}>, observedGeneration BIGINT>"""


# Enumerations and defaults of the resource contract.
RUN_STATES = ("RUNNING", "STOPPED", "DISABLED")
SERVICE_STATES = ("ENABLED", "DISABLED")
SCHEDULING_STRATEGIES = ("TIMER_DRIVEN", "CRON_DRIVEN", "EVENT_DRIVEN")
BULLETIN_LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
ENDPOINT_TYPES = (
    "PROCESSOR", "INPUT_PORT", "OUTPUT_PORT", "FUNNEL", "REMOTE_INPUT_PORT", "REMOTE_OUTPUT_PORT",
)
LOAD_BALANCE_STRATEGIES = (
    "DO_NOT_LOAD_BALANCE", "PARTITION_BY_ATTRIBUTE", "ROUND_ROBIN", "SINGLE_NODE",
)
LOAD_BALANCE_COMPRESSIONS = (
    "DO_NOT_COMPRESS", "COMPRESS_ATTRIBUTES_ONLY", "COMPRESS_ATTRIBUTES_AND_CONTENT",
)
CREDENTIAL_SOURCES = ("None", "Secret", "InjectedIdentity", "Environment", "Filesystem")
SYSTEM_VERSIONS = (1, 2)
MANAGEMENT_ACTIONS = ("Observe", "Create", "Update", "Delete", "LateInitialize", "*")
STALE_STATES = ("STALE", "LOCALLY_MODIFIED_AND_STALE")

DEFAULT_CONFIG_KIND = "ClusterProviderConfig"
SCOPED_CONFIG_KIND = "ProviderConfig"
DEFAULT_CONFIG_NAME = "default"
DEFAULT_POLICIES = ("*",)
DEFAULT_SYSTEM_VERSION = 2
ROOT_GROUP = "root"
