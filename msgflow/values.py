"""Labels, maps, word lists, patterns, thresholds and replies.

All of them are data that results depend on.  They must equal the values of the
system whose results this library reproduces, so they stand here plainly.
"""

# ---------------------------------------------------------------- fixed values

EMOTIONS = ["sadness", "joy", "love", "anger", "fear", "surprise"]  # position = raw id

EMOTION_SENTIMENT = {
    "sadness": "Negative/Frustrated",
    "anger": "Negative/Frustrated",
    "fear": "Negative/Frustrated",
    "joy": "Positive/Satisfied",
    "love": "Positive/Satisfied",
    "surprise": "Neutral",
}

SENTIMENTS = ["Negative/Frustrated", "Neutral", "Positive/Satisfied"]  # position = id

RAW_INTENT_ROUTING = {
    "track_order": "order_status",
    "delivery_options": "order_status",
    "delivery_period": "order_status",
    "cancel_order": "order_management",
    "change_order": "order_management",
    "place_order": "order_management",
    "check_cancellation_fee": "order_management",
    "check_invoice": "billing_and_refunds",
    "get_invoice": "billing_and_refunds",
    "get_refund": "billing_and_refunds",
    "track_refund": "billing_and_refunds",
    "check_refund_policy": "billing_and_refunds",
    "payment_issue": "billing_and_refunds",
    "check_payment_methods": "billing_and_refunds",
    "create_account": "account_management",
    "edit_account": "account_management",
    "delete_account": "account_management",
    "switch_account": "account_management",
    "recover_password": "account_management",
    "registration_problems": "account_management",
    "complaint": "complaint",
    "review": "complaint",
    "contact_customer_service": "out_of_scope",
    "contact_human_agent": "out_of_scope",
    "change_shipping_address": "out_of_scope",
    "set_up_shipping_address": "out_of_scope",
    "newsletter_subscription": "out_of_scope",
}

ROUTING_INTENTS = [
    "greeting", "goodbye", "gratitude", "order_status", "order_management",
    "billing_and_refunds", "account_management", "complaint", "out_of_scope",
]

# Small talk, in the order the rules are tried.  {s} is a whitespace character,
# {b} / {e} mean "no word character before / after".
SMALL_TALK_PATTERNS = {
    "greeting": "^{s}*(hi({s}+there)?|hello({s}+there)?|hey({s}+there)?"
                "|good{s}+(morning|afternoon|evening)|greetings){e}",
    "goodbye": "{b}(bye({s}+bye)?|goodbye|good{s}+bye|see{s}+you({s}+later)?"
               "|take{s}+care|farewell){e}",
    "gratitude": "{b}(thanks({s}+(a{s}+lot|so{s}+much|very{s}+much))?"
                 "|thank{s}+you({s}+(so{s}+much|very{s}+much))?"
                 "|thx|appreciate{s}+it|much{s}+appreciated){e}",
}

SMALL_TALK_FILLERS = [
    "there", "all", "everyone", "bot", "assistant", "team", "support", "friend",
    "you", "so", "much", "very", "a", "lot", "for", "your", "the", "help", "talk",
    "later", "again", "soon", "now", "have", "good", "great", "day", "one", "guys",
    "folks", "to", "and",
]

CONFIDENT = 0.55    # a model intent below this is in doubt
NOISE_FLOOR = 0.30  # below this it is noise, whatever the sentiment

DIRECT_INTENTS = ["greeting", "goodbye", "gratitude"]
KNOWLEDGE_INTENTS = [
    "order_status", "order_management", "billing_and_refunds", "account_management",
]

DIRECT_REPLIES = {
    "greeting": "Hello! How can I help you with your order or account today?",
    "goodbye": "Thanks for reaching out — have a great day!",
    "gratitude": "You're very welcome! Let me know if there's anything else I can help with.",
}
DIRECT_DEFAULT = "How can I help you today?"
REFUSAL_REPLY = (
    "I'm sorry, I'm not able to help with that particular request. "
    "Could you rephrase your question, or would you like me to connect you with a human agent?"
)
BLANK_REPLY = "It looks like your message was empty — could you tell me what you need help with?"
ESCALATION_NOTICE = (
    "\n\nI've also flagged this conversation for review by a human agent "
    "given the nature of your concern."
)
ANSWER_FALLBACK = (
    "I'm having trouble generating a response right now. "
    "Please try again shortly, or contact human support for immediate help."
)
FAILED_REPLY = (
    "Something went wrong processing your message. "
    "Please try again, or contact human support."
)
NO_CONTEXT = "(No relevant support information was found in the knowledge base.)"
PROMPT_CONTEXT = "Context (retrieved past support responses):\n"
PROMPT_BLOCK = ("[Support response ", "]\n")  # around its number
PROMPT_SENTIMENT = "\nDetected customer sentiment: "
PROMPT_QUESTION = ('\nCustomer question: "', '"\n')  # around the message
PLACEHOLDER_TOKEN = "{{PLACEHOLDER}}"
SYNTHETIC_EMOTION = "synthetic"

MODEL_TOP_K = 3    # documents per message in the message flow
SEARCH_TOP_K = 5   # documents per query when retrieval is called by itself

# ---------------------------------------------------------- end of fixed values
