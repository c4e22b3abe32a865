"""Panel operators: functions from DataFrames to DataFrames, and Column builders over a panel's windows."""
