"""Names, lists and patterns that results depend on."""

# --- fixed values: component types ---------------------------------------------------------------------------------
FIELD, OBJECT, CLASS, METHOD, TRIGGER = "CustomField", "CustomObject", "ApexClass", "ApexMethod", "ApexTrigger"
UI_TYPES = ("LightningComponentBundle", "AuraDefinitionBundle")
CODE_TYPES = (CLASS, TRIGGER, METHOD)

# --- fixed values: folder of a retrieved file -> metadata type -----------------------------------------------------
FOLDER_TYPES = {
    "classes": "ApexClass", "triggers": "ApexTrigger", "pages": "ApexPage", "components": "ApexComponent", "lwc": "LightningComponentBundle",
    "aura": "AuraDefinitionBundle", "staticresources": "StaticResource", "objects": "CustomObject", "fields": "CustomField", "layouts": "Layout",
    "flexipages": "FlexiPage", "quickActions": "QuickAction", "tabs": "CustomTab", "applications": "CustomApplication", "homePageLayouts": "HomePageLayout",
    "labels": "CustomLabels", "flows": "Flow", "flowDefinitions": "FlowDefinition", "workflows": "Workflow", "approvalProcesses": "ApprovalProcess",
    "assignmentRules": "AssignmentRules", "escalationRules": "EscalationRules", "autoResponseRules": "AutoResponseRules", "sharingRules": "SharingRules",
    "duplicateRules": "DuplicateRule", "matchingRules": "MatchingRule", "reports": "Report", "dashboards": "Dashboard", "reportTypes": "ReportType",
    "email": "EmailTemplate", "letterhead": "Letterhead", "profiles": "Profile", "permissionsets": "PermissionSet", "permissionsetgroups": "PermissionSetGroup",
    "customPermissions": "CustomPermission", "notificationtypes": "CustomNotificationType", "remoteSiteSettings": "RemoteSiteSetting",
    "namedCredentials": "NamedCredential", "pathAssistants": "PathAssistant", "customMetadata": "CustomMetadata", "globalValueSets": "GlobalValueSet",
}

# --- fixed values: file suffixes that are read as text (compared in lower case) -------------------------------------
TEXT_SUFFIXES = (
    ".xml .cls .trigger .page .component .cmp .app .evt .js .html .css .object .layout .flow .workflow .report .dashboard .reporttype .email .profile "
    ".permissionset .permissionsetgroup .flexipage .quickaction .tab .labels .sharingrules .assignmentrules .escalationrules .autoresponserules "
    ".duplicaterule .matchingrule .approvalprocess .weblink .custompermission .notiftype .remotesite .pathassistant .md"
).split()
CODE_SUFFIXES = (".cls", ".trigger", ".js", ".ts", ".page", ".component", ".cmp", ".app")
SCANNED_SUFFIXES = (".cls", ".trigger", ".js", ".ts")

# --- fixed values: consumers -----------------------------------------------------------------------------------------
WEAK_CONSUMERS = ("Profile", "PermissionSet", "PermissionSetGroup", "CustomApplication", "CustomTab", "SharingRules")
PLACEMENT_CONSUMERS = ("CustomApplication", "CustomTab")
LAYOUT_TYPES = ("Layout", "FlexiPage", "CompactLayout")
PRESENCE_ONLY = WEAK_CONSUMERS + LAYOUT_TYPES
ENTRY_POINT_TYPES = (
    "ApexTrigger Flow FlowDefinition Workflow ValidationRule ApprovalProcess AssignmentRules EscalationRules AutoResponseRules DuplicateRule MatchingRule "
    "Report Dashboard ReportType AnalyticSnapshot EmailTemplate QuickAction WebLink PathAssistant ApexPage ApexComponent CustomNotificationType "
    "PlatformEventChannelMember"
).split()
ACTIVE_FLAG_TYPES = ("Workflow", "ValidationRule", "ApprovalProcess", "DuplicateRule")

# --- fixed values: alias kinds that never are references, and kinds that are weak ones --------------------------------
NON_REFERENCE_KINDS = ("stripped_suffix", "label")
CUSTOM_SUFFIXES = ("__c", "__mdt", "__e", "__b", "__x")

# --- fixed values: words too common to be matched bare ---------------------------------------------------------------
COMMON_WORDS = (
    "active address amount balance brand category city code color comment comments company contact count country currency customer date day default "
    "description detail details discount email end error event file first flag group hour icon image index info item items key label language languages "
    "last level limit line link location manager message method minute mobile month name note notes number order owner page parent path phone picture "
    "price priority product quantity rate reason record region result role source start state status step street subject summary tag target tax team time "
    "title total type unit units url user value version week year zip abstract boolean break case catch class const continue date datetime decimal delete "
    "double else enum extends false final finally for get global id if implements import insert instanceof integer interface list long map merge new null "
    "object override private protected public return select set static string super switch test this throw transient true try undelete update upsert "
    "virtual void while with without sharing apiversion available content criteria deleted draft enabled field fields fullname inactive layout obsolete "
    "readonly required section settings true visible"
).split()
SHORTEST_BARE_WORD = 6

# --- fixed values: markers of dynamic access -------------------------------------------------------------------------
DYNAMIC_MARKERS = (
    "getglobaldescribe", "database.query", "database.querywithbinds", "database.countquery", "search.query", "type.forname", "getpopulatedfieldsasmap",
    "json.deserializeuntyped", "getsobjecttype", "fieldset.getfields", "sobjecttype.getdescribe", "schema.describesobjects", ".getdescribe(", "callable",
    "metadata.operations",
)

# --- fixed values: entry points of classes and methods ----------------------------------------------------------------
ENTRY_ANNOTATIONS = "auraenabled invocablemethod remoteaction future httpget httppost httpput httppatch httpdelete restresource istest testsetup".split()
CLASS_ENTRY_ANNOTATIONS = ("restresource",)
ENTRY_INTERFACES = "batchable schedulable queueable inboundemailhandler callable comparable allowscallouts triggerhandler".split()
ENTRY_METHODS = "execute start finish handleinboundemail call".split()
CLASS_KINDS = "rest scheduled batch queueable invocable aura email webservice entry test regular".split()

# --- fixed values: collectors, results, labels -------------------------------------------------------------------------
STATIC, POPULATION, DEPENDENCY, RUNTIME = "C10_static_index", "C20_data_population", "C30_dependency_api", "C40_runtime"
TEMPORAL, TAINT, REACHABILITY, CONFIG, REHEARSAL = "C50_temporal", "C60_dynamic_taint", "C70_reachability", "C80_config_data", "C90_rehearsal"
OPINIONS = "S40_opinions"
HIT, MISS, UNCLEAR, NOT_APPLICABLE = "EVIDENCE_OF_USE", "NO_EVIDENCE_FOUND", "INCONCLUSIVE", "NOT_APPLICABLE"
USED, UNUSED, REVIEW, OUT = "USED", "UNUSED", "NEEDS_REVIEW", "OUT_OF_SCOPE"
REQUIRED_COLLECTORS = {
    FIELD: (STATIC, POPULATION), OBJECT: (STATIC, POPULATION), CLASS: (STATIC, RUNTIME, REACHABILITY), TRIGGER: (STATIC, RUNTIME, REACHABILITY),
    METHOD: (STATIC, REACHABILITY), UI_TYPES[0]: (STATIC, REACHABILITY), UI_TYPES[1]: (STATIC, REACHABILITY),
}
INFORMATIONAL_FLAGS = ("RECENTLY_CHANGED", "LLM_CONFIRMS_USE")
TIER_RANK = {"A": 3, "B": 2, "C": 1, "D": 0}
STANDARD_ENTITIES = ("contact", "account", "user", "userfavorite", "organization")
SKIPPED_ENTRY_POINTS = ("execute_anonymous_apex", "triggers", "anonymousapex")

# --- fixed values: patterns (ASCII classes only, so that every engine agrees) --------------------------------------------
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*"
REPORT_COLUMN = r"[A-Za-z0-9_]+\$[A-Za-z0-9_]+"
MERGE_FIELD = r"\{!\s*([^}]{2,200})\}"

#: Fixed value: a credential's key and its value.
SECRETS = r"(?i)(password|secret|token|api[_-]?key|private[_-]?key|bearer)\s*[:=]\s*['\"]?[\p{L}\p{N}_\-./+=]{8,}"
