"""DataFrame operators over facts, entities, messages, queues and evaluations."""
