"""driftloom: DataFrame operators for streams whose feature set changes and whose labels are scarce."""
