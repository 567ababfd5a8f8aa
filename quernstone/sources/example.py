"""A small estate written for tests and demonstrations: three programs, copybooks, a job, a procedure, macros, a document."""

MEMBERS = {
    "SALES/cobol/ORDLOAD.cbl": """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. ORDLOAD.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT OUT-FILE ASSIGN TO ORDOUT.
       DATA DIVISION.
       FILE SECTION.
       FD OUT-FILE.
       01 OUT-REC. COPY ORDREC.
       WORKING-STORAGE SECTION.
       01 WS-STATE PIC X(2).
          88 STATE-OPEN VALUE 'OP'.
          88 STATE-SHUT VALUE 'SH' 'CL'.
       01 WS-NEXT PIC X(8) VALUE 'PRICER'.
       01 WS-KEY PIC X(10).
       01 WS-AMT PIC S9(7)V99 COMP-3.
       PROCEDURE DIVISION.
       MAIN-PARA.
           OPEN OUTPUT OUT-FILE.
           PERFORM FILL-PARA THRU FILL-EXIT.
           IF WS-STATE = 'ZZ' DISPLAY 'STATE ' WS-STATE ' IS WRONG'
           END-IF.
           CALL WS-NEXT USING WS-KEY WS-AMT.
           WRITE OUT-REC.
           STOP RUN.
       FILL-PARA.
           MOVE 'OP' TO WS-STATE.
           MOVE WS-KEY TO ORD-ID.
           MOVE WS-AMT TO ORD-AMT.
           EXEC SQL SELECT NAME, CITY INTO :WS-KEY, :WS-STATE
             FROM APP.CUSTOMER WHERE ID = :WS-KEY END-EXEC.
       FILL-EXIT.
           EXIT.
       LOST-PARA.
           CALL 'GONE'.
           STOP RUN.
""",
    "SALES/cobol/PRICER.cbl": """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. PRICER.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 WS-SAVE.
          05 WS-SAVE-KEY PIC X(6).
          05 WS-REST PIC X(4).
       LINKAGE SECTION.
       01 LK-KEY PIC X(10).
       01 LK-AMT PIC S9(7)V99 COMP-3.
       PROCEDURE DIVISION USING LK-KEY LK-AMT.
       P1.
           MOVE LK-KEY TO WS-SAVE-KEY.
           EXEC SQL UPDATE APP.PRICE SET AMT = :LK-AMT
             WHERE ID = :LK-KEY END-EXEC.
           GOBACK.
""",
    "SALES/cobol/ORDREAD.cbl": """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. ORDREAD.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT IN-FILE ASSIGN TO UT-S-ORDIN.
       DATA DIVISION.
       FILE SECTION.
       FD IN-FILE.
       01 IN-REC. COPY ORDREC REPLACING LEADING ORD BY INP.
       WORKING-STORAGE SECTION.
       01 WS-COPY PIC X(10).
       PROCEDURE DIVISION.
       P1.
           OPEN INPUT IN-FILE.
           READ IN-FILE.
           MOVE INP-ID TO WS-COPY.
           COPY NOTHERE.
           GOBACK.
""",
    "SALES/cobol/CUSTUPD.cbl": """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. CUSTUPD.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 FN-GU PIC X(4) VALUE 'GU  '.
       01 CUST-AREA PIC X(16).
       01 WS-PRICE PIC S9(7)V99 COMP-3.
       LINKAGE SECTION.
       01 IO-PCB PIC X(10).
       01 CUST-PCB PIC X(10).
       PROCEDURE DIVISION USING IO-PCB CUST-PCB.
       P1.
           CALL 'CBLTDLI' USING FN-GU CUST-PCB CUST-AREA.
           EXEC SQL SELECT AMT INTO :WS-PRICE FROM APP.PRICE
             WHERE ID = 1 END-EXEC.
           GOBACK.
""",
    "SALES/jcl/CUSTJOB.jcl": """\
//CUSTJOB  JOB (ACCT),'CUST'
//UPD      EXEC PGM=DFSRRC00,PARM='BMP,CUSTUPD,CUSTPSB'
""",
    "SALES/copy/ORDREC.cpy": """\
           05 ORD-ID        PIC X(10).
           05 ORD-AMT       PIC S9(7)V99 COMP-3.
           05 ORD-ALT REDEFINES ORD-AMT PIC X(5).
           05 ORD-QTY OCCURS 3 PIC 9(4) COMP.
           COPY ORDTAIL.
""",
    "SALES/copy/ORDTAIL.cpy": "           05 ORD-FLAG      PIC X.\n",
    "TEST/copy/ORDREC.cpy": "           05 ORD-ID        PIC X(12).\n",
    "SALES/jcl/NIGHT.jcl": """\
//NIGHT    JOB (ACCT),'LOAD'
//         SET HLQ=PROD
//LOAD     EXEC ORDPROC,ENV=&HLQ
//RUN.ORDOUT DD DSN=&HLQ..ORDERS(+1),
//            DISP=(NEW,CATLG)
//SORTED   EXEC PGM=SORT
//SORTIN   DD DSN=PROD.ORDERS(+1),DISP=SHR
//SORTOUT  DD DSN=PROD.ORDERS.SORTED,DISP=(NEW,CATLG)
//SYSIN    DD *
  SORT FIELDS=(1,10,CH,A)
/*
//READ     EXEC PGM=IKJEFT01
//ORDIN    DD DSN=PROD.ORDERS(0),DISP=SHR
//SYSTSIN  DD *
  DSN SYSTEM(DB2P)
  RUN PROGRAM(ORDREAD) PLAN(ORDPLAN)
/*
//LOST     EXEC NOPROC
""",
    "SALES/proc/ORDPROC.prc": """\
//ORDPROC  PROC ENV=TEST
//RUN      EXEC PGM=ORDLOAD
//ORDOUT   DD DSN=&ENV..DUMMY,DISP=SHR
//SYSOUT   DD SYSOUT=*
""",
    "SALES/ims/CUSTDB.dbd": """\
         DBD   NAME=CUSTDB,ACCESS=HDAM
         SEGM  NAME=CUST,PARENT=0,BYTES=16
         FIELD NAME=(CUSTKEY,SEQ,U),BYTES=10,START=1
         FIELD NAME=CUSTAMT,BYTES=5,START=11
""",
    "SALES/ims/CUSTPSB.psb": """\
         PCB   TYPE=DB,DBDNAME=CUSTDB,PROCOPT=A
         SENSEG NAME=CUST
         PSBGEN PSBNAME=CUSTPSB,CMPAT=YES
""",
    "SALES/online/APP.csd": """\
DEFINE TRANSACTION(ORDT) GROUP(APP)
       PROGRAM(PRICER)
DEFINE FILE(CUSTF) DSNAME(PROD.CUST)
""",
    "SALES/maps/ORDMAP.bms": """\
ORDSET   DFHMSD TYPE=MAP
ORDMAP1  DFHMDI SIZE=(24,80)
CUSTNO   DFHMDF POS=(3,10),LENGTH=8
         DFHMDF POS=(1,1),LENGTH=5,INITIAL='ORDER'
""",
    "SALES/docs/GUIDE.txt": "The load job writes the order file.\n\nThe order file is read each night.\n",
}
