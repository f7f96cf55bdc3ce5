"""Connective word and phrase lists, as published for the cohesion indices.

Fixed values: results depend on every item, its spelling and its list.
"""

# fixed values, in natural order, one list a name
SENTENCE_LINKERS = "nonetheless; therefore; although; furthermore; whereas; nevertheless; whatever; however; besides; henceforth; then; if; while; but; until; because; alternatively; meanwhile; when; notwithstanding; whenever; moreover; as; consequently".split("; ")
SENTENCE_LINKERS_CAVEAT = "for since after yet so".split("; ")
ORDER = "next; first; firstly; second; secondly; finally; then".split("; ")
ORDER_CAVEAT = "before; after".split("; ")
ORDER_NGRAM = "to begin with; in conclusion; above all".split("; ")
REASON_AND_PURPOSE = "therefore; hence; because; as; consequently".split("; ")
REASON_AND_PURPOSE_CAVEAT = "since; so".split("; ")
REASON_AND_PURPOSE_NGRAM = "that is why; for this reason; for that reason; because of; on account of; so that".split("; ")
ALL_CAUSAL = "although; arise; arises; arising; arose; because; cause; caused; causes; causing; condition; conditions; consequence; consequences; consequent; consequently; due to; enable; enabled; enables; enabling; even then; follow that; follow the; follow this; followed that; followed the; followed this; following that; follows the; follows this; hence; made; make; makes; making; nevertheless; nonetheless; only if; provided that; result; results; so; therefore; though; thus; unless; whenever".split("; ")
POSITIVE_CAUSAL = "arise; arises; arising; arose; because; cause; caused; causes; causing; condition; conditions; consequence; consequences; consequent; consequently; due; enable; enabled; enables; enabling; even; follow; followed; following; follows; hence; if; made; make; makes; making; only; provided; result; results; then; therefore; this; thus".split("; ")
ALL_LOGICAL = "actually; admittedly; also; alternatively; although; anyhow; anyway; because; besides; but; cause; caused; causes; causing; consequence; consequences; consequently; correspondingly; enable; enabled; enables; finally; for; fortunately; further; furthermore; hence; however; if; incidentally; instead; likewise; moreover; nevertheless; next; nonetheless; nor; or; otherwise; rather; secondly; similarly; summarizing; then; therefore; thereupon; though; thus; unless; whereas; while".split("; ")
ALL_LOGICAL_CAVEAT = "for; since; so".split("; ")
POSITIVE_LOGICAL = "actually; also; anyway; because; besides; cause; caused; causes; causing; consequence; consequences; consequently; correspondingly; enable; enabled; enables; finally; fortunately; further; furthermore; hence; if; incidentally; instead; likewise; moreover; next; secondly; similarly; summarizing; then; therefore; thereupon; thus; while".split("; ")
POSITIVE_LOGICAL_CAVEAT = "for; since; so".split("; ")
ALL_TEMPORAL = "earlier; finally; first; further; immediately; instantly; later; meanwhile; next; presently; previously; secondly; simultaneously; since; soon; suddenly; then; until; when; whenever; while".split("; ")
ALL_TEMPORAL_CAVEAT = "as; after; before".split("; ")
POSITIVE_INTENTIONAL = "desire; desired; desires; desiring; goal; goals; made; make; makes; making; purpose; purposes; want; wanted; wanting; wants".split("; ")
POSITIVE_INTENTIONAL_CAVEAT = "by; so".split("; ")
ALL_POSITIVE = "actually; also; and; anyway; arise; arises; arising; arose; as; because; besides; cause; caused; causes; causing; condition; conditions; consequence; consequences; consequent; consequently; correspondingly; desire; desired; desires; desiring; due; earlier; enable; enabled; enables; enabling; even; finally; first; follow; followed; following; follows; fortunately; further; furthermore; goal; goals; hence; if; immediately; incidentally; instead; likewise; made; make; makes; making; meanwhile; moreover; next; only; provided; presently; previously; purpose; purposes; result; results; secondly; similarly; simultaneously; since; so; soon; suddenly; summarizing; then; therefore; thereupon; throughout; thus; too; want; wanted; wanting; wants; when; whenever; while".split("; ")
ALL_POSITIVE_CAVEAT = "after; before; by".split("; ")
ALL_CONNECTIVE = "actually; admittedly; again; also; alternatively; although; and; anyhow; anyway; arise; arises; arising; arose; as; because; besides; but; cause; caused; causes; causing; condition; conditions; consequence; consequences; consequent; consequently; correspondingly; desire; desired; desires; desiring; enable; enabled; enables; enabling; finally; first; fortunately; further; furthermore; goal; goals; hence; however; if; immediately; incidentally; instead; likewise; made; make; makes; making; meanwhile; moreover; nevertheless; next; nonetheless; nor; or; otherwise; presently; previously; rather; secondly; similarly; simultaneously; since; summarizing; then; therefore; thereupon; though; throughout; thus; too; unless; until; whenever; whereas; while; yet".split("; ")
ALL_CONNECTIVE_CAVEAT = "after; before; by so".split("; ")
BASIC_CONNECTIVES = "and; nor; but; or; yet; so".split("; ")
CONJUNCTIONS = "and; but".split("; ")
DISJUNCTIONS = "or".split("; ")
COORDINATING_CONJUNCTS = "yet; so; nor; however; therefore".split("; ")
ADDITION = "and; also; besides; further; furthermore; too; moreover; in addition; then; another; indeed; likewise".split("; ")
OPPOSITION = "but; however; nevertheless; otherwise; on the other hand; on the contrary; yet; still; maybe; perhaps; instead; except for; in spite of; despite; nonetheless; apart from; unlike; whereas".split("; ")
DETERMINERS = "a; an; the; this; that; these; those".split("; ")
DEMONSTRATIVES = "this; that; these; those".split("; ")
ALL_ADDITIVE = "after all; again; all in all; also; alternatively; and; anyhow; as a final point; as well; at least; besides; but; by contrast; by the way; contrasted with; correspondingly; except that; finally; first; for example; for instance; fortunately; further; furthermore; however; in actual fact; in addition; in contrast; in fact; in other words; in sum; incidentally; instead; it follows; moreover; next; notwithstanding that; on one hand; on the contrary; on the one hand; on the other hand; or; otherwise; rather; secondly; similarly; summarizing; summing up; that is; thereupon; to conclude; to return to; to sum up; to summarize; to take an example; to these ends; to this end; too; well at any rate; whereas; yet".split("; ")
NEGATIVE_LOGICAL = "admittedly; alternatively; although; and conversely; anyhow; but; by contrast; contrasted with; despite the fact that; except that; however; in contrast; nevertheless; nonetheless; nor; notwithstanding that; on the contrary; on the other hand; or else; otherwise; rather; though; unless; whereas; yet".split("; ")
ALL_NEGATIVE = "admittedly; alternatively; although; and conversely; anyhow; but; by contrast; contrasted with; despite the fact that; except that; however; in contrast; nevertheless; nonetheless; nor; notwithstanding that; on the contrary; on the other hand; or; otherwise; rather; though; unless; until; whenever; whereas; yet".split("; ")
ALL_LOGICAL_NGRAM = "after all; all in all; and conversely; arise from; arise out of; arises from; arises out of; arising from; arising out of; arose from; arose out of; as a final point; as a result; as well; at least; at this point; conditional upon; contrasted with; despite the fact that; due to; except that; follow that; follow the; follow this; followed that; followed the; followed this; following that; follows the; follows this; in actual fact; in any case; in any event; in case; in conclusion; in contrast; in fact; in order that; in other words; in short; in sum; it followed that; it follows; it follows that; notwithstanding that; on condition that; on one hand; on the condition that; on the contrary; on the one hand; on the other hand; once again; provided that; purpose of which; pursuant to; summing up; that is; that is to say; to conclude; to return(to; to sum up; to summarize; to take an example; to that end; to these ends; to this end; to those ends; well at any rate".split("; ")
POSITIVE_LOGICAL_NGRAM = "after all; all in all; arise from; arise out of; arises from; arises out of; arising from; arising out of; arose from; arose out of; as a final point; as a result; as well; at least; at this point; conditional upon; due to; follow that; follow the; follow this; followed that; followed the; followed this; following that; follows the; follows this; in actual fact; in any case; in any event; in case; in conclusion; in fact; in order that; in other words; in short; in sum; it followed that; it follows; it follows that; on condition that; on one hand; on the condition that; on the one hand; once again; provided that; purpose of which; pursuant to; summing up; that is; that is to say; to conclude; to return to; to sum up; to summarize; to take an example; to that end; to these ends; to this end; to those ends; well at any rate".split("; ")
ALL_TEMPORAL_NGRAM = "a consequence of; all this time; at last; at once; at the same time; at this moment; at this point; by this time; follow that; following that; from now on; in the meantime; it followed that; it follows; it follows that; now that; on another occasion; once more; so far; the consequence of; the consequences of; the last time; the previous moment; this time; throughout; to that end; up till that time; up to now".split("; ")
POSITIVE_INTENTIONAL_NGRAM = "in order; to that end; to these ends; to this end; to those ends".split("; ")
ALL_POSITIVE_NGRAM = "all in all; at last; at least; at once; conditional upon; from now on; in actual fact; in addition; in any case; in any event; in case; in conclusion; in fact; in order; in other words; in short; in sum; on another occasion; on one hand; once more; summing up; well at any rate".split("; ")
ALL_CONNECTIVE_NGRAM = "all in all; all this time; at last; at least; at once; at the same time; at this moment; at this point; conditional upon; contrasted with; despite the fact that; due to; except that; follow that; follow the; follow this; followed that; followed the; followed this; following that; follows the; follows this; from now on; in actual fact; in addition; in any case; in any event; in case; in conclusion; in contrast; in fact; in order; in other words; in short; in sum; in the end; in the meantime; it followed that; it follows; it follows that; notwithstanding that; now that; on another occasion; on one hand; on the contrary; on the one hand; on the other hand; once more; provided that; purpose of which; pursuant to; summing up; that is; the last time; the previous moment; this time; to conclude; to return to; to sum up; to summarize; to take an example; to that end; to these ends; to this end; to those ends; up till that time; up to now; well at any rate".split("; ")
