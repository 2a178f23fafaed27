"""The 16 event schemas, their enums, and the topics that carry them.

Schemas are fixed, never inferred: pass them to every reader. `!` marks a mandatory field.
"""

from __future__ import annotations

from pyspark.sql import types as T

RESTRICTED = ("traderId", "accountId")

# Field names, types and enum symbols are the wire contract.
FIELDS = {
    "TradeEvent": "tradeId string!, correlationId string!, ticker string!, quantity long!, price double!, side Side!, traderId string!, accountId string!, eventTimestamp timestamp!, producedAt timestamp!, traceContext map!, sourceSystem string, sourceRecordKey string, sourceChangePosition string, migrationBatchId string",
    "MarketDataTickEvent": "ticker string!, bidPrice double!, askPrice double!, lastTradedPrice double!, volume long!, eventTimestamp timestamp!, producedAt timestamp!, correlationId string!, traceContext map!",
    "CorporateActionEvent": "corporateActionId string!, ticker string!, actionType CorporateActionType!, attributes map!, announcedAt timestamp!, effectiveAt timestamp!, producedAt timestamp!, correlationId string!, traceContext map!",
    "InstrumentReferenceEvent": "instrumentId string!, ticker string!, exchange string!, isin string!, securityType string!, currency string!, sector string!, sharesOutstanding long!, referenceVersion long!, effectiveAt timestamp!, producerIdentity string!",
    "DeadLetterEvent": "originalTopic string!, originalPartition int!, originalOffset long!, originalPayload binary!, failureReason string!, exceptionClass string!, exceptionMessage string!, stackTraceSummary string!, retryCount int!, firstFailureAt timestamp!, lastFailureAt timestamp!, consumerGroup string!, consumerInstance string!, correlationId string",
    "EnrichedTradeEvent": "trade TradeEvent!, midPriceAtExecution double!, spreadAtExecution double!, vwap5Min double!, marketCap double!, priceDeviation double!, enrichedAt timestamp!, enrichmentLatencyMs long!, marketDataAgeMs long!",
    "PositionSnapshotEvent": "snapshotId string!, accountId string!, traderId string!, ticker string!, netQuantity long!, grossBuyQuantity long!, grossSellQuantity long!, marketValue double!, asOf timestamp!, lastProcessedTradeId string!",
    "RiskAlertEvent": "alertId string!, correlationId string!, triggeringTradeId string!, alertType AlertType!, severity Severity!, ticker string!, traderId string!, description string!, ruleParameters map!, measuredValues map!, ruleId string!, ruleVersion long!, alertTimestamp timestamp!, traceContext map!",
    "RiskRuleLifecycleEvent": "ruleId string!, version long!, state RuleState!, ruleType string!, parameters map!, makerSubject string!, checkerSubject string, reason string!, effectiveAt timestamp, eventTimestamp timestamp!, correlationId string!",
    "AlertCaseEvent": "caseId string!, alertId string!, state CaseState!, actorSubject string!, actorRole string!, reasonCode string!, comment string, eventTimestamp timestamp!, correlationId string!",
    "ReconciliationEvent": "controlRunId string!, topic string!, partition int!, expectedFirstOffset long!, expectedLastOffset long!, archivedRecordCount long!, duplicateCount long!, missingCount long!, status ControlStatus!, executedAt timestamp!",
    "ReconciliationObservationEvent": "observationId string!, referenceId string!, observationType ReconciliationObservationType!, internalSourceRef string, externalSourceRef string, internalAmount double, externalAmount double, observedState map!, expectedParticipants int, participantsObserved int, completeness ObservationCompleteness!, observedAt timestamp!, correlationId string!, traceContext map!",
    "SecurityEvent": "securityEventId string!, subjectType string!, subjectId string!, action string!, resource string!, decision Decision!, reason string!, sourceService string!, correlationId string!, eventTimestamp timestamp!",
    "AnomalyCandidateEvent": "candidateId string!, sourceEventType string!, sourceEventId string!, category string!, priority CandidatePriority!, triggerSignals map!, evidenceRefs array!, requiresAgentInvestigation boolean!, createdAt timestamp!, correlationId string!, traceContext map!",
    "AgentDecisionEvent": "decisionId string!, candidateId string!, outcome AgentOutcome!, severity AgentSeverity!, confidence AgentConfidence!, reasonCodes array!, evidenceRefs array!, precedentRefs array!, toolStatus map!, narrative string!, critiqueApplied boolean!, critiqueTrigger string, modelId string!, promptVersion string!, toolsetVersion string!, inputTokens long!, outputTokens long!, estimatedCostUsd double!, decidedAt timestamp!, correlationId string!",
    "HumanReviewDecisionEvent": "reviewId string!, decisionId string!, reviewerId string!, verdict ReviewVerdict!, reasonCode string!, notes string, reviewedAt timestamp!, correlationId string!",
}
ENUMS = {
    "Side": ["BUY", "SELL"],
    "AlertType": ["POSITION_LIMIT_BREACH", "UNUSUAL_VOLUME", "PRICE_DEVIATION", "WASH_TRADE_DETECTED"],
    "Severity": ["INFO", "WARNING", "CRITICAL"],
    "CorporateActionType": ["DIVIDEND_DECLARATION", "STOCK_SPLIT", "EARNINGS_ANNOUNCEMENT", "RIGHTS_ISSUE"],
    "ControlStatus": ["PASS", "WARNING", "FAIL"],
    "RuleState": ["DRAFT", "PENDING_APPROVAL", "ACTIVE", "RETIRED", "REJECTED"],
    "CaseState": ["OPEN", "ACKNOWLEDGED", "INVESTIGATING", "CLOSED", "FALSE_POSITIVE"],
    "AgentOutcome": ["FLAG", "NO_FLAG", "ESCALATE", "INCONCLUSIVE"],
    "AgentSeverity": ["INFO", "WARNING", "CRITICAL"],
    "AgentConfidence": ["LOW", "MEDIUM", "HIGH", "NOT_APPLICABLE"],
    "CandidatePriority": ["LOW", "MEDIUM", "HIGH", "CRITICAL"],
    "ReviewVerdict": ["CONFIRM_FLAG", "REJECT_FLAG", "REQUEST_MORE_EVIDENCE", "ESCALATE", "CLOSE"],
    "Decision": ["ALLOW", "DENY", "ERROR"],
    "ReconciliationObservationType": ["DUPLICATE_REFERENCE", "AMOUNT_MISMATCH", "CONFLICTING_STATE", "MISSING_PARTICIPANT", "TIMING_UNCERTAINTY", "ROUNDING_OR_FEE_CANDIDATE"],
    "ObservationCompleteness": ["COMPLETE", "INCOMPLETE_EXPECTED", "INCOMPLETE_UNKNOWN"],
}
# Topics, their partitions and retention are the platform's catalogue.
#: topic: (partitions, retention in days or None if compacted, schema or None)
TOPICS = {
    "trades.raw": (12, 7, "TradeEvent"),
    "trades.enriched": (12, 7, "EnrichedTradeEvent"),
    "market-data.ticks": (12, 1, "MarketDataTickEvent"),
    "corporate-actions": (6, 30, "CorporateActionEvent"),
    "reference-data.instruments": (6, None, "InstrumentReferenceEvent"),
    "positions.snapshots": (12, 7, "PositionSnapshotEvent"),
    "notifications.alerts": (6, 3, "RiskAlertEvent"),
    "risk-rules.events": (6, 365, "RiskRuleLifecycleEvent"),
    "alert-cases.events": (6, 365, "AlertCaseEvent"),
    "controls.reconciliation": (6, 365, "ReconciliationEvent"),
    "security.events": (6, 365, "SecurityEvent"),
    "legacy.trades.cdc": (6, 3, None),
    "reconciliation.observations": (6, 7, "ReconciliationObservationEvent"),
    "anomaly.candidates": (6, 3, "AnomalyCandidateEvent"),
    "agent.decisions": (6, 30, "AgentDecisionEvent"),
    "review.decisions": (6, 365, "HumanReviewDecisionEvent"),
    "remediation.requested": (6, 30, None),
    "precedent.graph.sync": (6, 7, None),
    "trades.raw.dlq": (12, 30, "DeadLetterEvent"),
    "market-data.ticks.dlq": (12, 30, "DeadLetterEvent"),
    "corporate-actions.dlq": (6, 30, "DeadLetterEvent"),
    "reference-data.instruments.dlq": (6, 30, "DeadLetterEvent"),
}

TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "binary": T.BinaryType(), "timestamp": T.TimestampType(), "map": T.MapType(T.StringType(), T.StringType()), "array": T.ArrayType(T.StringType()),
}


def fields(name: str) -> list[tuple[str, str, bool]]:
    """(field, type, mandatory) of a schema."""
    return [(f, t.rstrip("!"), t.endswith("!")) for f, t in (x.split() for x in FIELDS[name].split(", "))]


def schema(name: str) -> T.StructType:
    """The StructType of an event; RESTRICTED fields carry their classification as metadata."""
    kind = lambda t: T.StringType() if t in ENUMS else schema(t) if t in FIELDS else TYPES[t]
    return T.StructType([T.StructField(f, kind(t), not must, {"classification": "RESTRICTED"} if f in RESTRICTED else {}) for f, t, must in fields(name)])


#: A record as a consumer sees it; value is null in a tombstone.
RECORD = T.StructType([
    T.StructField("topic", T.StringType(), False), T.StructField("partition", T.IntegerType(), False), T.StructField("offset", T.LongType(), False),
    T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType()), T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("headers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))),
])
