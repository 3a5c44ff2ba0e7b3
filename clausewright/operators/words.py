"""Word lists of the regulatory domain."""

# Fixed values.
INSTITUTIONS = [
    "European Parliament", "Parliament", "European Council", "Council", "Council of the European Union", "European Commission", "Commission",
    "Court of Justice of the European Union", "Court of Justice", "European Central Bank", "ECB", "Court of Auditors", "ENISA", "EBA", "ESMA", "EIOPA", "EASA",
    "EMA", "Europol", "Eurojust", "European Data Protection Board", "EDPB", "European Data Protection Supervisor", "EDPS", "Member State", "Member States",
]
ACTION_VERBS = [
    "notify", "report", "submit", "inform", "forward", "provide", "ensure", "adopt", "request", "assess", "investigate", "communicate", "cooperate", "consult",
    "advise", "establish", "designate", "publish", "approve", "receive", "review", "examine", "verify", "monitor",
]
NOT_ACTORS = [
    "application", "report", "decision", "guideline", "notice", "process", "procedure", "scheme", "data", "information", "document", "request", "notification",
    "measure", "regulation", "directive", "provision", "obligation", "right", "certificate", "assessment", "evaluation", "analysis", "review", "plan", "programme",
    "system", "framework", "mechanism", "criteria", "requirement", "condition", "period", "date", "paragraph", "article", "section", "annex", "chapter", "title",
    "recital", "incident", "threat", "impact", "loss", "disruption", "damage", "guidance", "warning", "summary", "contact", "act", "point", "recipient", "iaw",
    "union law", "such", "those", "these", "this", "relevant", "mere", "initial", "final", "significant", "cross-border",
]
DELEGATING_VERBS = ["ensure", "require", "oblige", "mandate", "order", "direct", "compel", "cause"]
REQUESTING_VERBS = ["request", "ask", "instruct", "invite"]
CONDITION_MARKERS = ["if", "where", "when", "unless", "provided", "insofar", "subject", "extent", "condition", "assuming", "given", "whenever"]
