"""draftloom: document and bill-of-materials analytics on Spark."""
